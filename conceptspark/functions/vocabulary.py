"""Closed vocabularies of the graph ontology and the label sets (fixed values)."""

# Entity types, relations, valences, edge groundings.
ENTITY_TYPES = ["Construct", "Value", "Stance", "CognitiveStyleMarker"]
RELATIONS = ["SERVES", "EXPRESSED_VIA", "MODULATED_BY", "CONFLICTS_WITH", "SUBSUMES", "IMPLIES"]
INFERENTIAL = ["SUBSUMES", "IMPLIES"]
VALENCES = ["positive", "negative", "mixed", "ambivalent"]
GROUNDINGS = ["explicit", "inferred"]
CSM_MIN_SPANS = 2

# Allowed (source types, target type) per relation; CONFLICTS_WITH is unconstrained.
SIGNATURES = {
    "SERVES": (["Construct"], "Value"),
    "EXPRESSED_VIA": (["Stance"], "Construct"),
    "MODULATED_BY": (["Construct", "Stance"], "CognitiveStyleMarker"),
    "SUBSUMES": (["Value"], "Value"),
    "IMPLIES": (["Construct"], "Construct"),
}

# Label encodings. Labels that are not listed have no code and are excluded.
COHORT_CODES = {"workforce": 0, "creatives": 1, "scientists": 2}
ADOPTION_CODES = {"tool_user": 0, "integrated": 1}
AMBIVALENCE_CODES = {"low": 0, "med": 1, "high": 2}
AMBIVALENCE_LABELS = ["low", "med", "high", "uncertain"]
CAREER_LABELS = ["early", "mid", "late", "uncertain"]
ADOPTION_LABELS = ["novice", "tool_user", "integrated", "power_user", "uncertain"]

# Substrings that mark a verification-oriented cognitive style.
VERIFY_KEYWORDS = [
    "verif",
    "systematic",
    "evidence",
    "empirical",
    "analytic",
    "rigour",
    "rigor",
    "precision",
    "cross-check",
    "cross-referenc",
    "source check",
]

# Names of the 30 structural features, in vector order.
FEATURE_NAMES = [
    "node_count_norm",
    "edge_count_norm",
    "density",
    "component_ratio",
    "avg_degree_norm",
    "max_degree_norm",
    "diameter_norm",
    "construct_ratio",
    "value_ratio",
    "stance_ratio",
    "csm_ratio",
    "construct_value_ratio",
    "stance_construct_ratio",
    "bipolarity_score",
    "mean_construct_degree",
    "max_construct_degree",
    "positive_stance_frac",
    "negative_stance_frac",
    "mixed_stance_frac",
    "ambivalent_stance_frac",
    "valence_positive",
    "valence_negative",
    "valence_mixed",
    "valence_ambivalent",
    "valence_absent",
    "max_betweenness",
    "mean_betweenness",
    "max_value_betweenness",
    "csm_present",
    "csm_count_clipped",
]

# The experiment grid.
TARGETS = ["ai_adoption", "cohort", "stance_ambivalence"]
MODALITY_COMBOS = ["text", "stats", "graph", "text-stats", "text-graph", "text-stats-graph"]
NEURAL_ARCHITECTURES = ["single", "stacked", "gated", "late"]
CLASSICAL_ARCHITECTURES = ["logistic", "random_forest", "gradient_boost", "svm"]
