"""Table schemas. Fixed, never inferred."""

from pyspark.sql import types as T

L, S, I, B = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


DOCUMENTS = _struct(
    ("id", L, False), ("provider_id", S, False), ("document_id", S, False), ("owner", S, True), ("title", S, True), ("content", S, True),
    ("link", S, True), ("source", S, True), ("modified", L, False), ("hash", S, True), ("extraction_cause", S, True),
)
ACCESS = _struct(("doc_id", L, False), ("token", S, False))
TAGS = _struct(("doc_id", L, False), ("kind", S, False), ("value", S, False))
POSTINGS = _struct(("term", S, False), ("doc_id", L, False), ("field", I, False), ("tf", I, False), ("positions", T.ArrayType(I), False), ("len", I, False), ("title_len", I, False))
DOC_STATS = _struct(("doc_id", L, False), ("len", I, False))
CHANGES = _struct(
    ("change_id", L, False), ("op", S, False), ("provider_id", S, False), ("document_id", S, False), ("title", S, True), ("owner", S, True),
    ("users", T.ArrayType(S), True), ("groups", T.ArrayType(S), True), ("circles", T.ArrayType(S), True), ("tags", T.ArrayType(S), True),
    ("link", S, True), ("source", S, True), ("modified", L, True), ("hash", S, True), ("content_encoded", B, True), ("received_at", T.TimestampNTZType(), True),
)
EXTRACTION = _struct(("text", S, True), ("cause", S, True), ("message", S, True))
