"""Fixed vocabularies of the data model."""

# Node labels, edge types, confidence tiers from weakest to strongest.
NODE_LABELS = (
    "Person", "Document", "Feature", "CodeSymbol", "Service", "ErrorGroup", "ServiceCard", "Decision", "Runbook", "Agent",
    "Workflow", "FixArtifact", "VerificationResult", "Project", "Experiment", "Run", "Artifact", "Asset", "AgentSession",
)
EDGE_TYPES = (
    "OWNS", "MENTIONS", "AUTHORED", "BLOCKS", "SUPERSEDES", "DUPLICATES", "TOUCHES", "FIRES_IN", "MEMBER_OF", "LINKED_FROM",
    "CONFLICTS_WITH", "VERIFIED_BY", "DERIVED_FROM", "FIXES", "REGRESSES", "ASSIGNED_TO", "COMPILED_FROM", "DESCRIBES", "CALLS",
    "IMPORTS", "INHERITS", "IMPLEMENTS", "REFERENCES", "DEFINED_IN", "DISCUSSES", "DOCUMENTS", "RESOLVES", "MENTIONS_ENTITY", "RELATES_TO",
)
CONFIDENCE = ("AMBIGUOUS", "INFERRED", "EXTRACTED")

# Chunking and ranking parameters.
CHUNK_TOKENS, CHUNK_OVERLAP = 512, 64
RRF_K = 60
HALF_LIFE_DAYS, MULTIPLIER = 120.0, 1.0
BM25_K1, BM25_B, TITLE_BOOST, POOL_MULTIPLIER, TITLE_ONLY_PER_DOC = 1.2, 0.75, 10.0, 10, 1
