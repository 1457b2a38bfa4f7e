"""Spark schemas of the records."""

from __future__ import annotations

DOCUMENT = "id string, title string, content string, metadata map<string,string>"
CHUNK = "id string, document_id string, text string, token_count int, chunk_order int, metadata map<string,string>"
ENTITY = "id string, name string, type string, description string, aliases array<string>, source_chunk_ids array<string>"
RELATION = "id string, src_id string, tgt_id string, keywords string, description string, weight double, source_chunk_ids array<string>, file_paths array<string>"
VECTOR = "namespace string, id string, vector array<double>, searchable_text string, keywords array<string>, metadata map<string,string>"
EXTRACTED_ENTITY = "struct<name:string,type:string,description:string,aliases:array<string>>"
EXTRACTED_RELATION = "struct<source:string,target:string,keywords:string,description:string,weight:double>"
EXTRACTION = f"document_id string, chunk_id string, chunk_order int, entities array<{EXTRACTED_ENTITY}>, relations array<{EXTRACTED_RELATION}>"
STATUS = "document_id string, status string, summary string, error_message string, chunks_count int, chunks_list array<string>"
BLOCK = "document_id string, block_id string, block_type string, text string, section_path string, section_hierarchy array<string>, page_no int, reading_order int, metadata map<string,string>"
RAW_SOURCE = "source_id string, file_name string, media_type string, bytes binary, metadata map<string,string>"
PARSED = f"document_id string, title string, plain_text string, blocks array<struct<{BLOCK.split(', ', 1)[1].replace(' map<string,string>', ':map<string,string>').replace(' ', ':').replace(',:', ',')}>>, metadata map<string,string>"
CHUNK_SNAPSHOT = "document_id string, chunk_id string, chunk_order int, content_hash string, extract_status string, entities array<" + EXTRACTED_ENTITY + ">, relations array<" + EXTRACTED_RELATION + ">"
JOURNAL = "document_id string, chunk_id string, snapshot_version int, status string, mode string, expected_entities array<string>, expected_relations array<string>, materialized_entities array<string>, materialized_relations array<string>, failure_stage string, updated_at timestamp"
TASK_EVENT = "event_id string, task_id string, scope string, event_type string, occurred_at timestamp, attributes map<string,string>"

#: The namespaces of vectors.
CHUNKS, ENTITIES, RELATIONS = "chunks", "entities", "relations"

#: Metadata keys of parents and children: kind, parent's id, parent's summary, and whether a search may find the chunk.
LEVEL, PARENT, SUMMARY, SEARCHABLE = "corvane.level", "corvane.parent", "corvane.parent_summary", "corvane.searchable"
