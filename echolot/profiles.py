"""Embedding models that are known by name, and the instructions that they expect."""

from __future__ import annotations

from dataclasses import dataclass, replace

DEFAULT_MODEL = "gte-modernbert-base"
CHECK_TASK, SEARCH_TASK = "semantic-similarity", "code-retrieval"
TASKS = (CHECK_TASK, SEARCH_TASK, "retrieval", "question-answering", "fact-verification", "classification", "clustering")


@dataclass(frozen=True)
class Profile:
    key: str
    canonical_name: str
    family: str = "generic"
    aliases: tuple[str, ...] = ()
    revision: str | None = None
    trust_remote_code: bool = False
    threshold: float = 0.82

    def names(self) -> tuple[str, ...]:
        return (self.key, self.canonical_name, *self.aliases)


PROFILES = (
    Profile("gte-modernbert-base", "Alibaba-NLP/gte-modernbert-base", "gte-modernbert", ("gte-modernbert",), threshold=0.96),
    Profile("c2llm-0.5b", "codefuse-ai/C2LLM-0.5B", "c2llm", revision="bd6d0ddb29f0c9a3d0f14281aedc9f940bb8d67a", trust_remote_code=True, threshold=0.80),
    Profile("embeddinggemma-300m", "unsloth/embeddinggemma-300m", "embeddinggemma", ("google/embeddinggemma-300m", "embeddinggemma"), threshold=0.86),
)
_BY_NAME = {n.lower(): p for p in PROFILES for n in p.names()}
_FAMILY = Profile("", "", "c2llm", trust_remote_code=True)
_GEMMA = {
    CHECK_TASK: "sentence similarity", SEARCH_TASK: "code retrieval", "retrieval": "search result", "question-answering": "question answering",
    "fact-verification": "fact checking", "classification": "classification", "clustering": "clustering",
}


def profile(name: str) -> Profile:
    """By any of its names, in whatever case; else one of its family where the name tells it, or a generic one."""
    own = name.strip().lower()
    if own in _BY_NAME:
        return _BY_NAME[own]
    return replace(_FAMILY if "c2llm" in own else Profile("", ""), key=name, canonical_name=name)


def task(name: str | None, default: str) -> str:
    if name is None:
        return default
    own = name.strip().lower()
    if own not in TASKS:
        raise ValueError(f"Unknown semantic task '{name}'. Expected one of: {', '.join(TASKS)}")
    return own


def instruction(model: str, query: bool, semantic_task: str, prefix: str | None = None) -> str:
    """What stands before the text: ``prefix`` if given, else what the model's family expects."""
    if prefix is not None:
        return prefix
    family = profile(model).family
    if family == "c2llm":
        return "Represent this query for searching relevant code: " if query else "Represent this code for finding similar code: "
    if family == "embeddinggemma":
        if not query and semantic_task in ("retrieval", SEARCH_TASK):
            return "title: none | text: "
        return f"task: {_GEMMA[semantic_task]} | query: "
    return ""


def load_options(model: str, revision: str | None, trust: bool | None) -> dict:
    """Name, revision and trust in remote code: what is given, else the profile's."""
    p = profile(model)
    return {"name": p.canonical_name, "revision": p.revision if revision is None else revision, "trust_remote_code": p.trust_remote_code if trust is None else trust}
