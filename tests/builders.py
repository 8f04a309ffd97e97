"""Hand-made graphs as node and edge tables."""

from conceptspark.schemas import EDGE, NODE
from pyspark.sql import types as T

GRAPH_ID = T.StructField("graph_id", T.LongType())
NODES = T.StructType([GRAPH_ID, *NODE.fields])
EDGES = T.StructType([GRAPH_ID, *EDGE.fields])
GRAPHS = T.StructType([GRAPH_ID, T.StructField("split", T.StringType()), T.StructField("domain", T.StringType())])


def node(graph, id_, type_, **fields):
    base = {f: None for f in NODE.fieldNames()}
    base.update(id=id_, type=type_, label=f"label {id_}")
    if type_ == "Construct":
        base.update(
            label_negative="other", bipolarity_complete=True, grounding_spans_positive=["p"], grounding_spans_negative=["n"]
        )
    else:
        base.update(grounding_spans=["a", "b"])
    if type_ == "Stance":
        base["valence"] = "positive"
    base.update(fields)
    return (graph, *[base[f] for f in NODE.fieldNames()])


def edge(graph, source, target, relation, rationale="because", grounding="inferred"):
    return (graph, source, target, relation, rationale, grounding)


def tables(spark, nodes, edges, graphs):
    return (
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame(edges, EDGES),
        spark.createDataFrame(graphs, GRAPHS),
    )


def plain_graphs(spark, shapes):
    """Graphs given as {id: (node ids, arcs)}; nodes named v… are Values, the others Constructs."""
    nodes = [node(g, n, "Value" if n.startswith("v") else "Construct") for g, (ids, _) in shapes.items() for n in ids]
    edges = [edge(g, s, t, r) for g, (_, arcs) in shapes.items() for s, t, r in [(*a, "SERVES")[:3] for a in arcs]]
    return tables(spark, nodes, edges, [(g, "workforce", "d") for g in shapes])
