"""p8: subject areas of documents."""

from quillspan.llm import subjects as sj
from quillspan.session import table


def _on(f):
    return lambda s, d: f(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects"))


QUERIES = {"p8_found": _on(sj.found), "p8_composition": _on(sj.composition)}

ORACLE: dict[str, str] = {}
