"""Word index and search operators."""

from cairnspark.functions import names as n
from cairnspark.functions import search_language


def find(d, text: str) -> str:
    """Ids of the files that a search in the search language finds; one scan, no shuffle. An empty search finds none."""
    words = d.sub(f"lower(name || ' ' || {n.pieces(d, 'name')})", r"[^a-z0-9]+", " ")
    folders = d.sub("lower(folder)", r"[^a-z0-9]+", " ")
    where = search_language.predicate(d, search_language.parse(text), ["words_text", "folders_text"])
    return f"SELECT id FROM (SELECT *, ' ' || trim({words}) || ' ' AS words_text, ' ' || trim({folders}) || ' ' AS folders_text FROM files) s WHERE {where}"


OPERATORS = {
    "c03_search_language": lambda d: find(d, 'samp type:.GZ after:2024-01-01 size:>=0.1k is:file'),
    "c03_search_phrase": lambda d: find(d, '"library en" run1 before:2024-02-31 <1MB'),
    "c03_search_empty": lambda d: find(d, "* !!"),
    "q27_fs_search": lambda d: f"SELECT id, path FROM files WHERE contains(lower(name), 'run2') AND NOT {d.rlike('path', '(^|/)[.][^/]')} AND size > 100",
    "x13_truncated": lambda d: "SELECT count(*) > 50 AS truncated FROM (SELECT id FROM files WHERE size > 500 ORDER BY id LIMIT 51) t",
}
