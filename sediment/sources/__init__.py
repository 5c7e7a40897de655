"""Sources and sinks: text, logs, metrics, repositories, Office files, exports, embeddings."""
