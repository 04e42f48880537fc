"""Settings, with their checks."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

LOADERS = {"git": "yek --json $1", "pdf": "pdftotext $1 -"} | dict.fromkeys(("docx", "odt", "rtf", "epub", "rst", "org"), "pandoc --to plain $1")


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


@dataclass(frozen=True)
class Settings:
    embedding_model: str | None = None
    chunk_size: int = 1000
    chunk_overlap: int = 100
    top_k: int = 5
    search_mode: str = "hybrid"
    rrf_k: int = 60
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    diversity_lambda: float = 1.0
    reranker_model: str | None = None
    reranker_top_k: int | None = None
    reranker_max_length: int | None = None
    query_aware_weights: bool = True
    retrieval_candidates: int | None = None
    bm25_algorithm: str = "plus"
    bm25_language: str | None = None
    bm25_stemmed: bool = True
    near_dedup_enabled: bool = True
    near_dedup_threshold: float = 0.8
    near_dedup_num_perm: int = 128
    contextual_headers: bool = True
    max_memory_mb: float = 500
    filter_placement: str = "reference"
    document_loaders: dict[str, str] = field(default_factory=lambda: dict(LOADERS))

    def __post_init__(self):
        def need(ok: bool, name: str, what: str) -> None:
            if not ok:
                raise ValueError(f"{name} must be {what}, not {getattr(self, name)!r}")

        for name in ("chunk_size", "top_k"):
            need(_whole(getattr(self, name)) and getattr(self, name) > 0, name, "a positive integer")
        need(_whole(self.chunk_overlap) and 0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap", "an integer from 0 and less than chunk_size")
        need(self.search_mode in ("vector", "keyword", "hybrid"), "search_mode", "vector, keyword or hybrid")
        need(_whole(self.rrf_k) and 1 <= self.rrf_k <= 100, "rrf_k", "an integer from 1 to 100")
        for name in ("vector_weight", "keyword_weight"):
            need(isinstance(getattr(self, name), (int, float)) and getattr(self, name) >= 0, name, "a number from 0")
        need(self.vector_weight + self.keyword_weight > 0, "vector_weight", "more than 0 if keyword_weight is 0")
        need(isinstance(self.diversity_lambda, (int, float)) and 0 <= self.diversity_lambda <= 1, "diversity_lambda", "from 0 to 1")
        need(self.reranker_model is None or isinstance(self.reranker_model, str), "reranker_model", "a name or none")
        need(self.reranker_top_k is None or _whole(self.reranker_top_k) and self.reranker_top_k > 0, "reranker_top_k", "a positive integer or none")
        need(self.reranker_max_length is None or _whole(self.reranker_max_length) and 64 <= self.reranker_max_length <= 512, "reranker_max_length", "from 64 to 512 or none")
        need(self.retrieval_candidates is None or _whole(self.retrieval_candidates) and self.retrieval_candidates >= 2, "retrieval_candidates", "an integer from 2 or none")
        need(self.bm25_algorithm in ("plus", "okapi"), "bm25_algorithm", "plus or okapi")
        need(self.bm25_language is None or isinstance(self.bm25_language, str), "bm25_language", "a language or none")
        for name in ("query_aware_weights", "bm25_stemmed", "near_dedup_enabled", "contextual_headers"):
            need(isinstance(getattr(self, name), bool), name, "true or false")
        need(isinstance(self.near_dedup_threshold, (int, float)) and 0 < self.near_dedup_threshold <= 1, "near_dedup_threshold", "over 0 and at most 1")
        need(_whole(self.near_dedup_num_perm) and 16 <= self.near_dedup_num_perm <= 512, "near_dedup_num_perm", "from 16 to 512")
        need(isinstance(self.max_memory_mb, (int, float)) and self.max_memory_mb > 0, "max_memory_mb", "a positive number")
        need(self.filter_placement in ("reference", "pre"), "filter_placement", "reference or pre")

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    def with_loader(self, name: str, command: str) -> Settings:
        """The settings with a loader added or changed."""
        return self.with_(document_loaders=self.document_loaders | {name: command})

    def without_loader(self, name: str) -> Settings:
        """The settings without a loader; one that isn't there is no error."""
        return self.with_(document_loaders={k: v for k, v in self.document_loaders.items() if k != name})

    def candidates(self, k: int) -> int:
        """How many each search retrieves for k results."""
        return self.retrieval_candidates or min(100, max(20, 10 * k))

    def rerank_length(self) -> int:
        """Tokens that a reranker reads."""
        return self.reranker_max_length or min(512, max(128, self.chunk_size // 4 + 32))

    def embedding_batch(self, n: int, *, most: int | None = None, tokens: int | None = None) -> int:
        """Chunks embedded at once: at most 100, and what the model takes."""
        if most:
            return max(1, min(most, n, 100))
        if tokens:
            return max(1, min(tokens * 4 // self.chunk_size, n, 100))
        return max(1, min(100, n))


def deep_merge(base: dict, over: dict) -> dict:
    """base with the values of over, dicts merged at every depth; neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path) -> Settings:
    """Settings from a YAML file over the defaults; a file that is absent or can't be read gives the defaults."""
    import logging

    import yaml

    try:
        read = yaml.safe_load(Path(path).read_text()) or {}
    except FileNotFoundError:
        return Settings()
    except (OSError, yaml.YAMLError) as e:
        logging.getLogger(__name__).warning("settings in %s can't be read: %s", path, e)
        return Settings()
    merged = deep_merge(asdict(Settings()), read)
    return Settings(**{f.name: merged[f.name] for f in fields(Settings)})


def save(settings: Settings, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(asdict(settings), allow_unicode=True))


def checked_name(name: str) -> str:
    """A collection's name, which is also a folder's."""
    if not name or ".." in name or name.startswith(".") or not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a name of a collection: {name!r}")
    return name
