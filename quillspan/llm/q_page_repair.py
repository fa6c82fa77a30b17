"""p3: noise in text from scanned pages."""

from quillspan.llm import page_repair as pr
from quillspan.session import table

QUERIES = {
    "p3_found": lambda s, d: pr.found(table(s, d, "packet_lines"), table(s, d, "notebooks")),
    "p3_paragraphs": lambda s, d: pr.paragraphs(table(s, d, "packet_lines"), table(s, d, "notebooks")),
}

ORACLE: dict[str, str] = {}
