"""Row types of the datasets. Times are epoch seconds; seq is the order of insertion; sign stands for a local embedding."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_S, _L, _I = StringType(), LongType(), IntegerType()


def _of(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


CHUNKS = _of(id=_S, file_path=_S, kind=_S, name=_S, start_line=_I, end_line=_I, content=_S, embedding=ArrayType(DoubleType()), sign=_I, updated_at=_L, seq=_L)
FILE_META = _of(path=_S, mtime=_L, git_updated_at=_L)
MEMORIES = _of(id=_S, content=_S, tags=ArrayType(_S), embedding=ArrayType(DoubleType()), stale=BooleanType(), created_at=_L, last_seen_at=_L, seq=_L)
GRAPH_EDGES = _of(from_file=_S, to_file=_S)
QUERY_LOG = _of(query_hash=_S, chunk_id=_S, action=_S, ts=_L)
CHECKPOINTS = _of(id=_S, summary=_S, open_tasks=ArrayType(_S), created_at=_L, seq=_L)
CONTEXT_STATE = _of(file=_S)
VECTORS = _of(hash=_S, embedding=ArrayType(DoubleType()))
POSTINGS = _of(file_path=_S, id=_S, term=_S, frequency=_L)
LENGTHS = _of(file_path=_S, id=_S, tokens=_I, length=_I)

TABLES = {"chunks": CHUNKS, "file_meta": FILE_META, "memories": MEMORIES, "graph_edges": GRAPH_EDGES, "query_log": QUERY_LOG, "checkpoints": CHECKPOINTS, "context_state": CONTEXT_STATE, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}

#: Of the tables whose rows are replaced by key.
KEYS = {"chunks": "file_path", "file_meta": "path", "postings": "file_path", "lengths": "file_path"}

#: How folders of rows lie: by these columns (dealt by the first if True), and with Bloom filters of those that rows are looked up by.
LAYOUT = {"chunks": ("id", False, ("id",)), "graph_edges": ("to_file", True, ("to_file", "from_file")), "vectors": ("hash", False, ("hash",)), "postings": ("term", True, ("term",))}
