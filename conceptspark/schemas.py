"""Fixed schemas: one superset document schema for every prompt version, plus the long-table columns."""

from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("label_negative", T.StringType()),
        T.StructField("bipolarity_complete", T.BooleanType()),
        T.StructField("valence", T.StringType()),
        T.StructField("grounding_span", T.StringType()),
        T.StructField("grounding_spans", T.ArrayType(T.StringType())),
        T.StructField("grounding_spans_positive", T.ArrayType(T.StringType())),
        T.StructField("grounding_spans_negative", T.ArrayType(T.StringType())),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("grounding", T.StringType()),
    ]
)

GRAPH = T.StructType(
    [
        T.StructField("transcript_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("extraction_model", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("edges", T.ArrayType(EDGE)),
        T.StructField("validation_violations", T.ArrayType(T.StringType())),
    ]
)

TAGGED = T.StructType(
    [
        T.StructField("transcript_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("n_ai_turns", T.LongType()),
        T.StructField("n_human_turns", T.LongType()),
        T.StructField(
            "turns",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("speaker", T.StringType()),
                        T.StructField("text", T.StringType()),
                        T.StructField("turn_index", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("formatted", T.StringType()),
    ]
)

ANNOTATION = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("quotes", T.ArrayType(T.StringType())),
    ]
)

RAW_TRANSCRIPT = T.StructType(
    [T.StructField("transcript_id", T.StringType()), T.StructField("text", T.StringType())]
)

NODE_COLUMNS = ["graph_id"] + NODE.fieldNames()
EDGE_COLUMNS = ["graph_id"] + EDGE.fieldNames()
