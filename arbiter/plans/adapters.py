"""What a domain's pipelines need to know, and the registry of retrievers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from arbiter.functions import text


@dataclass(frozen=True)
class Adapter:
    """Anchor and superseding record types, the scope they share, and how a question names it."""

    anchor_type: str
    superseding_type: str
    scope_keys: tuple[str, ...]
    entities: Callable[[str], Column] | None = None


SECURITY = Adapter("cve_disclosed", "patch_released", ("product", "cve_id"), text.security_entities)
LEGAL = Adapter("ruling_issued", "ruling_overruled", ("case_slug",), text.legal_entities)
FINANCE = Adapter("pre_clearance_approved", "blackout_announced", ("employee_id", "security_ticker"), text.finance_entities)
CONVERSATION = Adapter("user", "assistant", ("conv_id",))

DOMAINS = {"security": SECURITY, "legal": LEGAL, "finance": FINANCE, "conversation": CONVERSATION}


def make_pipeline(records: DataFrame, domain: str | Adapter, k1: int = 20, extra: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Two-stage retrieval over a domain's records, as a function of a first ranking."""
    from arbiter.operators import pipelines

    adapter = domain if isinstance(domain, Adapter) else DOMAINS[domain]
    return lambda ranking: pipelines.two_stage(ranking, records, adapter, k1, extra)


#: ``retrieve(corpus, queries, k) -> DataFrame(qid, doc_id, rank, score)`` by name.
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}


def register_retriever(name: str, retrieve: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
    RETRIEVERS[name] = retrieve


def retrieve(name: str, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    if name not in RETRIEVERS:
        raise KeyError(f"no retriever named {name!r}; there are {', '.join(sorted(RETRIEVERS))}")
    return RETRIEVERS[name](corpus, queries, k)


def load_retriever(path: str, name: str) -> None:
    """Registers ``retrieve`` of a Python file of the user's own."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("user_retriever", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "retrieve", None)):
        raise ValueError(f"{path} has no function retrieve(corpus, queries, k)")
    register_retriever(name, module.retrieve)


def _defaults() -> None:
    from arbiter.operators import relevance

    register_retriever("bm25", lambda c, q, k: relevance.bm25(c, q, k))
    register_retriever("bm25_terms", lambda c, q, k: relevance.bm25(c, q, k, tokenizer="a", dup_terms=True))
    register_retriever("okapi", lambda c, q, k: relevance.okapi_top(c, q, k))
    register_retriever("tfidf", lambda c, q, k: relevance.tfidf_top(c, q, k))


_defaults()
