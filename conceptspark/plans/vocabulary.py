"""Canonical vocabulary and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.functions.vectors import scaled_text
from conceptspark.operators import canonical, embeddings, features, splits, transcripts, word_vectors
from conceptspark.plans.graphs import VIOLATIONS
from conceptspark.plans.registry import query
from conceptspark.session import scratch_path

MAX_DIST = 0.8
UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"

VECTORS = {
    "fx_unit": f"SELECT vec_id AS id, label AS type, {UNIT} AS u FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "fx_map": """
        SELECT DISTINCT type, label, concat(substr(type, 1, 1), '-', substr(md5(label), 1, 1)) AS canonical
        FROM fx_nodes WHERE label <> '' AND substr(md5(label), 1, 1) <> '0'""",
    "fx_mapped": """
        SELECT n.*, m.canonical FROM fx_nodes n LEFT JOIN fx_map m ON m.type = n.type AND m.label = n.label""",
    "fx_bag": """
        SELECT graph_id, d, avg(x) AS x FROM (
            SELECT graph_id, unnest(range(1, 65)) AS d, unnest(u) AS x FROM fx_nodes n JOIN (
                SELECT type, label, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS u
                FROM fx_label_vectors) v ON v.type = n.type AND v.label = n.label) GROUP BY ALL""",
    "fx_bag_text": """
        SELECT graph_id, string_agg(CAST(round(x * 1000000.0) AS BIGINT)::VARCHAR, ',' ORDER BY d) AS features
        FROM fx_bag GROUP BY 1""",
    "fx_counts4": """
        SELECT graph_id, count(*) FILTER (type = 'Construct') AS a, count(*) FILTER (type = 'Value') AS b,
            count(*) FILTER (type = 'Stance') AS c, count(*) FILTER (type = 'CognitiveStyleMarker') AS d
        FROM fx_nodes GROUP BY 1""",
    "fx_counts_text": "SELECT graph_id, concat_ws(',', a * 1000000, b * 1000000, c * 1000000, d * 1000000) AS features FROM fx_counts4",
}


def mapping(c):
    """Deterministic map over the corpus labels; labels whose md5 starts with 0 stay unmapped."""
    digit = F.substring(F.md5("label"), 1, 1)
    return (
        canonical.distinct_labels(c.nodes)
        .where(digit != "0")
        .withColumn("canonical", F.concat(F.substring("type", 1, 1), F.lit("-"), digit))
    )


def items(c):
    return c.vectors.withColumnRenamed("vec_id", "id")


@query("c01_distinct_labels", "SELECT DISTINCT type, label FROM fx_nodes WHERE label <> ''")
def _(c):
    return canonical.distinct_labels(c.nodes)


@query(
    "c02_cosine_pairs",
    f"""SELECT a.type, a.id, b.id AS other, round(1 - list_dot_product(a.u, b.u), 6) AS distance FROM fx_unit a
    JOIN fx_unit b ON a.type = b.type AND a.id < b.id WHERE 1 - list_dot_product(a.u, b.u) < {MAX_DIST}""",
    VECTORS,
)
def _(c):
    return canonical.cosine_pairs(items(c), MAX_DIST).withColumn("distance", F.round("distance", 6))


@query("c03_average_linkage")
def _(c):
    return canonical.average_linkage(items(c), 0.8)


CLUSTERS = {
    **VECTORS,
    "fx_members": "SELECT type, id, id % 7 AS cluster, concat('l', id) AS label, u FROM fx_unit",
    "fx_centres": """
        SELECT type, cluster, list(x ORDER BY d) AS c FROM (
            SELECT type, cluster, d, avg(x) AS x FROM (SELECT type, cluster, unnest(range(1, 65)) AS d, unnest(u) AS x
                FROM fx_members) GROUP BY ALL) GROUP BY ALL""",
}


@query(
    "c04_canonical_label",
    """SELECT type, cluster, label AS canonical FROM fx_members JOIN fx_centres USING (type, cluster)
    QUALIFY row_number() OVER (PARTITION BY type, cluster ORDER BY
        round(1 - list_dot_product(u, c) / sqrt(list_dot_product(c, c)), 12), label) = 1""",
    CLUSTERS,
)
def _(c):
    members = items(c).select(
        "type", (F.col("id") % 7).alias("cluster"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"), "vector"
    )
    return canonical.canonical_label(members)


@query("c05_build_canonical_map")
def _(c):
    return canonical.build_canonical_map(canonical.distinct_labels(c.nodes), c.label_vectors, 0.8)


@query(
    "c06_vocabulary_sizes",
    """SELECT type, count(*) AS n_labels, count(DISTINCT canonical) AS n_canonical FROM fx_map GROUP BY 1
    UNION ALL SELECT 'ALL', count(*), count(DISTINCT concat(type, canonical)) FROM fx_map""",
    VECTORS,
)
def _(c):
    return canonical.vocabulary_sizes(mapping(c))


@query("c07_lock_map", "SELECT * FROM fx_map", VECTORS)
def _(c):
    path = scratch_path(c.spark, "map")
    canonical.lock_map(mapping(c), path, 0.35)
    return canonical.load_locked_map(c.spark, path)


@query(
    "c08_apply_canonical",
    "SELECT graph_id, id, type, coalesce(canonical, label) AS label FROM fx_mapped",
    VECTORS,
)
def _(c):
    return canonical.apply_canonical(c.nodes, mapping(c)).select("graph_id", "id", "type", "label")


@query(
    "c09_unmapped_labels",
    "SELECT graph_id, count(*) AS n_unmapped FROM fx_mapped WHERE canonical IS NULL GROUP BY 1",
    VECTORS,
)
def _(c):
    return canonical.unmapped_labels(c.nodes, mapping(c))


@query(
    "c10_canonicalise_corpus",
    """SELECT (SELECT count(*) FROM fx_graphs) AS n_graphs,
        (SELECT count(*) FROM fx_graphs WHERE graph_id NOT IN (SELECT graph_id FROM fx_violations WHERE rule <> 'V21'))
            AS n_clean,
        (SELECT count(*) FROM fx_mapped WHERE canonical IS NULL) AS n_unmapped,
        (SELECT count(*) FROM fx_violations WHERE rule = 'V21') AS n_fixed""",
    {**VIOLATIONS, **VECTORS},
)
def _(c):
    return canonical.canonicalise_corpus(c.nodes, c.edges, c.graphs, mapping(c))[3]


@query(
    "c11_sample_clusters",
    """SELECT type, canonical, place::INT AS place, n AS n_members, array_to_string(list_slice(list_sort(ls), 1, 5), '|') AS members,
        greatest(n - 5, 0) AS n_more
    FROM (SELECT type, canonical, count(*) AS n, list(label) AS ls,
        row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, canonical) AS place FROM fx_map GROUP BY type, canonical)
    WHERE place <= 5""",
    VECTORS,
)
def _(c):
    return canonical.sample_clusters(mapping(c)).withColumn("members", F.array_join("members", "|"))


# embeddings


def bag(c):
    return embeddings.label_bag(c.nodes, c.label_vectors, c.graphs, 64)


def modality(df):
    return df.withColumnRenamed("graph_id", "transcript_id")


def type_counts(c):
    counted = c.nodes.groupBy("graph_id").agg(*features.type_counts())
    names = ["n_construct", "n_value", "n_stance", "n_csm"]
    return counted.select("graph_id", F.array(*[F.col(n).cast("double") for n in names]).alias("features"))


def modalities(c):
    return {"label_bag": modality(bag(c)), "counts": modality(type_counts(c))}


def graph_ids(c):
    return c.graphs.select(F.col("graph_id").alias("transcript_id"))


@query("e01_text_features")
def _(c):
    texts = transcripts.filter_speaker_text(transcripts.parse_turns(c.transcripts), "Human")
    return word_vectors.learned_text_features(texts)


@query("e02_label_bag", "SELECT graph_id, features FROM fx_bag_text", VECTORS)
def _(c):
    return bag(c).select("graph_id", scaled_text(F.col("features")).alias("features"))


@query(
    "e03_align_modalities",
    """SELECT graph_id AS transcript_id, concat(c.features, ',', b.features) AS features
    FROM fx_counts_text c JOIN fx_bag_text b USING (graph_id)""",
    VECTORS,
)
def _(c):
    both = embeddings.align_modalities(modalities(c))
    return both.select("transcript_id", scaled_text(F.col("features")).alias("features"))


@query(
    "e04_missing_from",
    """SELECT 'a' AS name, graph_id AS transcript_id FROM fx_graphs WHERE graph_id % 5 = 0
    UNION ALL SELECT 'b', graph_id FROM fx_graphs WHERE graph_id % 7 = 0""",
)
def _(c):
    ids = graph_ids(c)
    return embeddings.missing_from(ids, {"a": ids.where("transcript_id % 5 <> 0"), "b": ids.where("transcript_id % 7 <> 0")})


@query(
    "e05_swap_modality",
    """SELECT graph_id AS transcript_id, concat((a + b + c + d) * 1000000, ',', features) AS features
    FROM fx_counts4 JOIN fx_bag_text USING (graph_id)""",
    VECTORS,
)
def _(c):
    total = c.nodes.groupBy("graph_id").agg(F.array(F.count("*").cast("double")).alias("features"))
    swapped = embeddings.swap_modality(modalities(c), "counts", modality(total))
    both = embeddings.align_modalities(swapped)
    return both.select("transcript_id", scaled_text(F.col("features")).alias("features"))


@query("e06_select_modalities", "SELECT graph_id AS transcript_id, features FROM fx_counts_text", VECTORS)
def _(c):
    kept = embeddings.select_modalities(modalities(c), ["counts"])
    return embeddings.align_modalities(kept).select("transcript_id", scaled_text(F.col("features")).alias("features"))


@query(
    "d07_slice",
    """SELECT s.transcript_id, s.label, c.features FROM fx_splits s JOIN fx_counts_text c ON c.graph_id = s.transcript_id
    WHERE s.target = 'cohort' AND s.seed = 42 AND s.split = 'test'""",
    VECTORS,
)
def _(c):
    counts = modality(type_counts(c))
    covered = splits.restrict_split(c.splits_of([42]).where("target = 'cohort'"), graph_ids(c))
    out = embeddings.labelled_slice(covered, {"counts": counts}, "cohort", 42, "test")
    return out.select("transcript_id", "label", scaled_text(F.col("features")).alias("features"))
