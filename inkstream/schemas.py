"""Declared schemas of tables and JSON payloads; nothing is inferred."""

from __future__ import annotations

#: Domain event envelope as it travels in a stream.
EVENT_ENVELOPE = """
    event_id STRING, event_type STRING, aggregate_id STRING, aggregate_type STRING, event_data STRING,
    timestamp TIMESTAMP, version INT, correlation_id STRING, causation_id STRING, metadata STRING
"""

#: Payloads by event type (fixed values: names as published).
UPLOADED, STARTED = "DocumentUploaded", "DocumentProcessingStarted"
COMPLETED, FAILED = "DocumentProcessingCompleted", "DocumentProcessingFailed"
UPLOADED_DATA = "file_name STRING, file_size BIGINT"
STARTED_DATA = "processing_pipeline STRING"
FAILED_DATA = "error_message STRING, error_code STRING, retry_count INT"
RESULT = """
    STRUCT<document_type: STRING, processing_duration: DOUBLE, confidence: DOUBLE,
           entities: STRUCT<entities: MAP<STRING, STRING>>, sentiment: STRUCT<sentiment: STRING>, language: STRING>
"""
COMPLETED_DATA = f"processing_result {RESULT}, processing_duration DOUBLE"

#: The document-processing stream.
DOCUMENT_STREAM = """
    document_id BIGINT, event_time TIMESTAMP, user_id BIGINT, document_type STRING, processing_duration DOUBLE,
    success BOOLEAN, error_code STRING, error_message STRING, confidence DOUBLE, file_size BIGINT,
    sentiment STRING, sentiment_score DOUBLE, detected_language STRING,
    entities ARRAY<STRUCT<entity_type: STRING, entity_confidence: DOUBLE>>
"""

USERS = "id STRING, email STRING, name STRING, created_at TIMESTAMP, updated_at TIMESTAMP, is_active BOOLEAN"
PROCESSING_JOBS = """
    id STRING, user_id STRING, document_name STRING, document_path STRING, status STRING, created_at TIMESTAMP,
    completed_at TIMESTAMP, error_message STRING, processing_metadata STRING
"""
ANALYTICS_METRICS = "id STRING, metric_name STRING, metric_value DOUBLE, metric_timestamp TIMESTAMP, metadata STRING"
DOCUMENTS = """
    id STRING, document_id STRING, user_id STRING, file_name STRING, file_size BIGINT, content_type STRING,
    blob_path STRING, document_type STRING, status STRING, metadata STRING, processing_options STRING,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""
DOCUMENT_RESULTS = """
    id STRING, document_id STRING, extracted_text STRING, entities STRING, summary STRING, confidence DOUBLE,
    processing_time DOUBLE, cost DECIMAL(10,4), created_at TIMESTAMP
"""
AUTOMATION_SCORES = """
    document_id STRING, confidence_score DOUBLE, completeness_score DOUBLE, validation_pass BOOLEAN,
    automation_score DOUBLE, requires_review BOOLEAN, created_at TIMESTAMP
"""
CONVERSATION_MESSAGES = """
    conversation_id STRING, user_id STRING, message STRING, response STRING, sources STRING, timestamp TIMESTAMP
"""
DOCUMENT_ENTITIES = """
    document_id STRING, entity_type STRING, entity_value STRING, confidence_score DECIMAL(5,4),
    start_position INT, end_position INT, page_number INT, extracted_at TIMESTAMP
"""
