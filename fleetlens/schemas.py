"""Table schemas and the fixed values the operators take as defaults."""

from __future__ import annotations

# --- schemas -------------------------------------------------------------------------------

METRIC = "timestamp TIMESTAMP, metric_name STRING, value DOUBLE, model_id STRING, instance STRING"

RANGE_RESPONSE = (
    "status STRING, metric_name STRING, "
    "data STRUCT<resultType: STRING, result: ARRAY<STRUCT<metric: MAP<STRING, STRING>, values: ARRAY<ARRAY<STRING>>>>>"
)

INFERENCE_LOG = (
    "event_id BIGINT, timestamp TIMESTAMP, model_id STRING, instance STRING, endpoint STRING, latency DOUBLE, "
    "error STRING, status_code INT, level STRING, context STRING, message STRING"
)

REGISTRY = (
    "MAP<STRING, STRUCT<port: INT, url: STRING, status: STRING, features: ARRAY<STRING>, "
    "registered_at: DOUBLE, last_updated: DOUBLE>>"
)

# --- fixed values --------------------------------------------------------------------------

BASIC_METRICS = ["requests_total", "latency_avg", "latency_p95", "latency_p99"]
HOST_METRICS = ["cpu_usage_real", "memory_usage_real", "network_io_real"]
LATENCY_METRICS = ["latency_avg", "latency_p95", "latency_p99"]

VALUE_RANGES = {
    "requests_total": (0.0, 1000000.0),
    "latency_avg": (0.0, 100.0),
    "latency_p95": (0.0, 100.0),
    "latency_p99": (0.0, 100.0),
    "cpu_usage_real": (0.0, 100.0),
    "memory_usage_real": (0.0, 100.0),
    "network_io_real": (0.0, 10.0 * 1024 * 1024 * 1024),
}

FORECAST_FLOORS = {
    "latency_avg": 0.005,
    "latency_p95": 0.010,
    "latency_p99": 0.015,
    "cpu_usage_real": 0.1,
    "memory_usage_real": 1.0,
    "network_io_real": 1.0,
    "requests_total": 0.0,
}

THRESHOLDS = {
    "latency_rules": {"critical": 5.0, "warning": 1.0, "batch": 30.0},
    "error_rules": {"max_error_rate": 0.05, "consecutive_errors": 5.0, "error_window": 100.0},
    "resource_rules": {"cpu_threshold": 80.0, "memory_threshold": 85.0, "disk_threshold": 90.0},
    "model_performance_rules": {
        "min_accuracy": 0.90,
        "accuracy_drop_threshold": 0.05,
        "feature_drift_threshold": 0.1,
    },
    "health_rules": {"max_startup_time": 300.0, "healthcheck_interval": 60.0, "dependency_timeout": 10.0},
}

# Upper bounds of the response-time histogram; +Inf closes it.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf")]

SIZING_WEIGHTS = {"cpu": 0.4, "memory": 0.3, "network": 0.3}

# Rules: alert name, severity, threshold, hold time in seconds.
RULE_HIGH_LATENCY = ("HighLatency", "warning", 1.0, 120)
RULE_ERROR_SPIKE = ("PredictionErrorSpike", "critical", 3.0, 60)
RULES_MODEL = {
    "cpu_usage_percent": ("ModelHighCPUUsage", "warning", 75.0, 300),
    "memory_gigabytes": ("ModelHighMemoryUsage", "warning", 1.5, 300),
    "network_bytes_per_second": ("ModelHighNetworkTraffic", "warning", 50000000.0, 300),
}
RULES_HOST = {
    "cpu_percent": ("HighCPUUsage", "warning", 80.0, 300),
    "memory_percent": ("HighMemoryUsage", "warning", 85.0, 300),
    "disk_percent": ("HighDiskUsage", "warning", 85.0, 300),
    "network_bytes_per_second": ("HighNetworkTraffic", "warning", 100000000.0, 300),
}

# Alert descriptions; {name} stands for a label.
DESCRIPTIONS = {
    "HighLatency": "Model prediction latency has been over 1s for 2 minutes",
    "PredictionErrorSpike": "More than 3 errors in last 5 minutes",
    "ModelHighCPUUsage": "Model {model_id} ({instance}) CPU usage is above 75% for 5 minutes",
    "ModelHighMemoryUsage": "Model {model_id} ({instance}) memory usage is above 1.5GB for 5 minutes",
    "ModelHighNetworkTraffic": "Model {model_id} ({instance}) network traffic is above 50MB/s for 5 minutes",
    "HighCPUUsage": "CPU usage is above 80% for 5 minutes on {instance}",
    "HighMemoryUsage": "Memory usage is above 85% for 5 minutes on {instance}",
    "HighDiskUsage": "Disk usage is above 85% for 5 minutes on {instance} mount point {mountpoint}",
    "HighNetworkTraffic": "Network traffic is above 100MB/s for 5 minutes on {instance}",
}
SUMMARIES = {
    "HighLatency": "High model latency",
    "PredictionErrorSpike": "Spike in prediction errors",
    "ModelHighCPUUsage": "High model CPU usage",
    "ModelHighMemoryUsage": "High model memory usage",
    "ModelHighNetworkTraffic": "High model network traffic",
    "HighCPUUsage": "High CPU usage detected",
    "HighMemoryUsage": "High memory usage detected",
    "HighDiskUsage": "High disk usage detected",
    "HighNetworkTraffic": "High network traffic detected",
}

EVAL_STEP = 15  # seconds between rule evaluations and between range-query points
RATE_RANGE = 300  # seconds a rate looks back
GROUP_WAIT = 10  # seconds before a group of alerts is first sent
GROUP_INTERVAL = 10  # seconds between looks at a group for changes
RESOLVE_TIMEOUT = 300  # seconds after which an alert that isn't reported any more is resolved
REPEAT_INTERVAL = 3600  # seconds before an unchanged group is sent again
ALERT_LIFETIME = 1800  # seconds an alert stays active
MAX_FAILED_CHECKS = 3
