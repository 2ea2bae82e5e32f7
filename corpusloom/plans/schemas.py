"""Tables, enums and additive schema changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and types of tables and columns.
TABLES = {
    "courses": "id string, name string, created_at string",
    "textbooks": "id string, title string, filepath string, course string, library_type string, processed_at string, created_at string",
    "chapters": "id string, textbook_id string, chapter_number string, title string, page_start int, page_end int, description_path string",
    "conversations": "id string, course_id string, query string, created_at string",
    "messages": "id string, conversation_id string, role string, content string, created_at string",
    "university_materials": "id string, course_id string, title string, file_type string, filepath string, created_at string",
    "sections": "id string, chapter_id string, section_number int, title string, page_start int, page_end int",
    "extracted_content": "id string, chapter_id string, content_type string, title string, content string, file_path string, page_number int, order_index int",
    "material_summaries": "id string, material_id string, course_id string, summary_json string, created_at string",
    "material_relevance_results": "id string, material_id string, course_id string, textbook_id string, entry_id string, entry_type string, entry_title string, entry_level int, page_start int, page_end int, relevance_score double, matched_topics string, reasoning string, parent_entry_id string, created_at string",
    "concept_nodes": "id string, textbook_id string, title string, description string, node_type string, level string, source_chapter_id string, source_section_id string, source_page int, metadata_json string, created_at string",
    "concept_edges": "id string, textbook_id string, source_node_id string, target_node_id string, relationship_type string, confidence double, reasoning string, created_at string",
    "graph_generation_jobs": "id string, textbook_id string, status string, progress_pct double, total_chapters int, processed_chapters int, error string, created_at string, completed_at string",
    "settings": "key string, value string, updated_at string",
}

# Columns that came later, with what old rows get.
ADDED: list[tuple[str, str, str, object]] = [
    ("textbooks", "course_id", "string", None),
    ("textbooks", "pipeline_status", "string", "uploaded"),
    ("chapters", "extraction_status", "string", "pending"),
    ("sections", "parent_section_id", "string", None),
    ("sections", "level", "int", 2),
    ("university_materials", "relevance_status", "string", "none"),
    ("concept_edges", "metadata_json", "string", None),
]

# States and kinds.
PIPELINE_STATES = ("uploaded", "toc_extracted", "awaiting_verification", "extracting", "partially_extracted", "fully_extracted", "error")
QUALIFYING_STATES = ("toc_extracted", "awaiting_verification", "extracting", "partially_extracted", "fully_extracted")
RELATIONSHIPS = ("derives_from", "proves", "prerequisite_of", "uses", "generalizes", "specializes", "contradicts", "defines", "equivalent_form", "variant_of", "contains")
NODE_LEVELS = ("chapter", "section", "subsection")
NODE_TYPES = ("theorem", "definition", "equation", "lemma", "corollary", "axiom", "proof", "identity", "formula", "law", "principle", "theory", "hypothesis", "observation", "constant", "property", "method", "technique", "algorithm", "procedure", "criterion", "model", "approximation", "rule", "condition", "relation", "concept", "result", "example", "variable", "parameter")
JOB_STATES = ("pending", "processing", "completed", "failed")
EXTRACTION_STATES = ("pending", "selected", "extracting", "extracted", "deferred", "error")
CONTENT_TYPES = ("table", "figure", "equation", "text")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return migrate(spark.createDataFrame([], TABLES[table]), table)


def migrate(df: DataFrame, table: str) -> DataFrame:
    """df with the columns that came later, where they are missing; twice is as once."""
    return df.withColumns({c: F.lit(v).cast(kind) for t, c, kind, v in ADDED if t == table and c not in df.columns})
