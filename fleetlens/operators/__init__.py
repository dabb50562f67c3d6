"""DataFrame to DataFrame operators; lazy, nothing is collected."""
