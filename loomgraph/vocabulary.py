"""What the text jobs look for, and the parameters of retrieval. All of it is data: every corpus may bring its own."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The default vocabulary, for technical talk in English and Korean.
KEYWORDS = (
    "rag", "retrieval", "generation", "entity", "graph", "knowledge", "traceability", "embedding", "vector", "neo4j", "fastapi", "docker", "algorithm", "attention",
    "batching", "cache", "inference", "latency", "throughput", "d3", "query", "ranking", "rerank", "검색", "그래프", "임베딩", "어텐션", "배칭", "캐시", "추론", "지연", "처리량",
)
PHRASES = (
    "continuous batching", "연속 배칭", "paged attention", "페이지드 어텐션", "kv-cache", "kv 캐시", "graph rag", "graph-centric rag", "그래프 rag", "그래프 기반 rag", "entity graph",
    "vector rag", "벡터 rag", "top-k", "top k", "beam search", "빔 서치", "cosine similarity", "코사인 유사도",
)
RELATION_MARKERS = (
    ("COMPARES", ("compare", "vs", "versus", "비교", "차이")),
    ("DEPENDS_ON", ("depend", "depends on", "requires", "need", "의존", "필요")),
    ("IMPLEMENTS", ("implement", "build with", "using", "구현", "사용해")),
    ("EXPLAINS", ("explain", "means", "정의", "설명", "what is")),
)
SYNONYMS = {
    "pagedattention": "paged attention", "continuousbatching": "continuous batching", "연속 배칭": "continuous batching", "연속배칭": "continuous batching",
    "페이지드 어텐션": "paged attention", "페이지드어텐션": "paged attention", "kv cache": "kv-cache", "kv 캐시": "kv-cache", "케이브이 캐시": "kv-cache",
    "knowledge graph": "entity graph", "graph rag": "graph-centric rag", "그래프 rag": "graph-centric rag", "그래프 기반 rag": "graph-centric rag", "graphrag": "graph-centric rag",
    "벡터 rag": "vector rag",
}
TYPE_MARKERS = (
    ("algorithm", ("algorithm", "attention", "batching", "rerank", "어텐션", "배칭")),
    ("technology", ("neo4j", "postgres", "fastapi", "d3", "python", "docker", "도커")),
)
IMPORTANCE = (
    (r"지침\s*변경|instruction\s*change|new\s*policy", 0.45),
    (r"정정|수정|교정|오류|실수|fix|wrong|correct", 0.35),
    (r"확정|결정|합의|final\s+decision|adopt", 0.30),
)
PRIORS = {"EXPLAINS": 1.0, "DEPENDS_ON": 0.95, "IMPLEMENTS": 0.92, "COMPARES": 0.82, "RELATED_TO": 0.70}
OTHER_PRIOR = 0.65
OTHER_RELATION, OTHER_TYPE = "RELATED_TO", "concept"

#: Entries of a vocabulary that are written into a plan at most.
LITERALS = 200


@dataclass(frozen=True)
class Vocabulary:
    keywords: tuple[str, ...] = KEYWORDS
    phrases: tuple[str, ...] = PHRASES
    relation_markers: tuple[tuple[str, tuple[str, ...]], ...] = RELATION_MARKERS
    synonyms: dict[str, str] = field(default_factory=lambda: dict(SYNONYMS))
    type_markers: tuple[tuple[str, tuple[str, ...]], ...] = TYPE_MARKERS
    importance: tuple[tuple[str, float], ...] = IMPORTANCE
    min_length: int = 3
    max_ngram: int = 3
    #: Whether entries are looked up by automaton and tables instead of literals; None: from ``LITERALS`` entries on. Results are equal.
    tables: bool | None = None

    @property
    def large(self) -> bool:
        return len(self.keywords) + len(self.phrases) + len(self.synonyms) > LITERALS if self.tables is None else self.tables


@dataclass(frozen=True)
class Chunking:
    """Sizes in words; a size or an overlap of 0 means the default."""

    default_size: int = 256
    default_overlap: int = 32
    structured_size: int = 192
    structured_overlap: int = 24
    max_size: int = 512
    profile: str = "auto"
    min_lines: int = 3
    heading_ratio: float = 0.20

    def __post_init__(self) -> None:
        if self.profile not in ("auto", "default", "structured"):
            raise ValueError(f"no such chunk profile: {self.profile}")

    def sized(self, structured: bool) -> tuple[int, int]:
        """Size and overlap of a profile."""
        size, overlap = (self.structured_size or 192, self.structured_overlap or 24) if structured else (self.default_size or 256, self.default_overlap or 32)
        size = max(8, size)
        return min(size, max(8, self.max_size)), max(0, min(overlap, size - 1))


#: What a request may ask for.
RANGES = (("top_k", 1, 50), ("max_hops", 1, 6), ("beam_width", 1, 1000), ("rerank_top_n", 1, 1000))


@dataclass(frozen=True)
class Retrieval:
    """Parameters of a batch of queries. ``check`` holds the ranges that a request may use."""

    top_k: int = 10
    max_hops: int = 2
    beam_width: int = 24
    seed_limit: int = 24
    prune_threshold: float = 0.05
    hybrid: bool = True
    graph_weight: float = 0.62
    embedding_weight: float = 0.23
    lexical_weight: float = 0.15
    importance_weight: float = 0.0
    recency_weight: float = 0.0
    half_life_hours: float = 72.0
    rerank: bool = False
    rerank_top_n: int = 20
    rerank_weight: float = 0.20

    def check(self) -> Retrieval:
        for name, low, high in RANGES:
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is {getattr(self, name)}, not from {low} to {high}")
        return self

    def weights(self) -> tuple[float, float, float]:
        """Graph, embedding and lexical weight: none below 0, sum 1; without any, the defaults."""
        own = [max(0.0, w) for w in (self.graph_weight, self.embedding_weight, self.lexical_weight)]
        total = sum(own)
        return tuple(w / total for w in own) if total > 1e-9 else (0.62, 0.23, 0.15)

    def applied(self) -> dict[str, float | int | bool]:
        """What was applied, for the record."""
        g, e, x = self.weights()
        return {
            "top_k": self.top_k, "max_hops": self.max_hops, "beam_width": self.beam_width, "prune_threshold": round(self.prune_threshold, 6), "hybrid_enabled": self.hybrid,
            "graph_weight": round(g, 6), "embedding_weight": round(e, 6), "lexical_weight": round(x, 6), "importance_weight": round(self.importance_weight, 6),
            "recency_weight": round(self.recency_weight, 6), "recall_half_life_hours": self.half_life_hours, "rerank_enabled": self.rerank, "rerank_top_n": self.rerank_top_n,
            "rerank_weight": round(min(1.0, max(0.0, self.rerank_weight)), 6),
        }

    def but(self, **changes) -> Retrieval:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


#: Ranking profiles that are compared with each other. None of them feeds recall back or looks at importance or recency.
PROFILES = {
    "graph_only": Retrieval(hybrid=False, graph_weight=1.0, embedding_weight=0.0, lexical_weight=0.0),
    "lexical_only": Retrieval(graph_weight=0.0, embedding_weight=0.0, lexical_weight=1.0),
    "embedding_only": Retrieval(graph_weight=0.0, embedding_weight=1.0, lexical_weight=0.0),
    "hybrid": Retrieval(),
    "hybrid_rerank": Retrieval(rerank=True),
}
