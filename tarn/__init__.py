"""tarn: ad-hoc SQL over files and event logs, planned by Spark."""
