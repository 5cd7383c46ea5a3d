"""Schemas of the engine's tables, as DDL."""

CHUNK_METADATA = "struct<origin:string,split_index:int,content_type:string,image_id:int,image_path:string,split_from:string>"
CHUNKS = (
    "id string, text string, raw_text string, source_type string, document_name string, embedding_text string, "
    f"headings array<string>, page_numbers array<int>, metadata {CHUNK_METADATA}"
)
IMAGES = "document_name string, image_id int, image string, image_path string, description string, page_numbers array<int>, page int, bbox array<double>"
MANIFEST = "document_name string, document_path string, document_hash string, process_vision boolean, artifact_schema_version int, image_metadata_hash string"
TEXT_BLOCKS = "document_id string, page_no int, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, text string"
REGIONS = "document_id string, page_no int, kind string, region_no int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
PAGES = "document_id string, page_no int, markdown string, error string"
