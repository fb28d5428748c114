"""Settings in key = value files, in layers."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """None: not set in this layer."""

    include_tests: bool | None = None
    batch_files: int | None = None
    max_file_size: int | None = None
    token_budget: int | None = None
    max_nodes: int | None = None
    max_files: int | None = None
    rrf_k: int | None = None
    lexical_top_k: int | None = None
    dense_top_k: int | None = None
    rerank_top_k: int | None = None
    enable_rerank: bool | None = None
    mode: str | None = None
    max_depth: int | None = None
    exclude: tuple[str, ...] | None = None
    format: str | None = None
    install_target: str | None = None
    use_lsp: bool | None = None
    stats_enabled: bool | None = None
    packing: str | None = None
    ranking: str | None = None
    embedding_model: str | None = None
    reranker_model: str | None = None
    embedding_tokenizer: str | None = None
    rerank_tokenizer: str | None = None
    strategy: str | None = None
    embed_batch_size: int | None = None
    extraction_tier: str | None = None
    threads: int | None = None
    lsp_mode: str | None = None
    incremental: bool | None = None
    provider: str | None = None


DEFAULTS = Settings(False, 32, 524_288, 12_000, 200, 50, 60, 50, 50, 20, False, mode="smart", max_depth=10, embed_batch_size=16)
#: Other names of keys, the values that a key takes, and keys whose number is at least one.
ALIASES = {
    "bm25_top_k": "lexical_top_k", "budget": "token_budget", "default_token_budget": "token_budget", "tests": "include_tests", "rerank": "enable_rerank", "build_batch_size": "batch_files", "default_format": "format", "agent_format": "format",
    "mcp_target": "install_target", "target": "install_target", "lsp": "use_lsp", "collect_stats": "stats_enabled", "stats": "stats_enabled", "default_packing": "packing", "default_ranking": "ranking",
    "embedding_model_path": "embedding_model", "reranker_model_path": "reranker_model", "embedding_tokenizer_dir": "embedding_tokenizer", "rerank_tokenizer_dir": "rerank_tokenizer",
    "default_retrieval_strategy": "strategy", "retrieval_strategy": "strategy", "tier": "extraction_tier", "parallel_threads": "threads", "incremental_indexing": "incremental", "embedding_execution_provider": "provider", "embedding_provider": "provider",
}
CHOICES = {"mode": ("smart", "all", "code", "docs", "llm"), "lsp_mode": ("off", "light", "full"), "provider": ("auto", "cpu", "coreml")}
POSITIVE = ("batch_files", "embed_batch_size")


def parse(text: str) -> Settings:
    """Unknown keys and values that don't fit are left out; # and ; start comments outside quotes. tokenizer_dir sets both tokenizers that aren't set."""
    kinds = {f.name: f.type for f in fields(Settings)}
    found: dict[str, object] = {}
    for line in text.splitlines():
        quoted, end = False, len(line)
        for i, c in enumerate(line):
            quoted ^= c == '"'
            if c in "#;" and not quoted:
                end = i
                break
        key, equals, value = line[:end].partition("=")
        key = key.strip().lower().replace("-", "_")
        key, value = ALIASES.get(key, key), value.strip()
        plain = value.strip('"')
        if not equals:
            continue
        if key == "tokenizer_dir":
            for k in ("embedding_tokenizer", "rerank_tokenizer"):
                found.setdefault(k, plain)
        elif key not in kinds:
            continue
        elif "bool" in kinds[key]:
            if plain.lower() in ("true", "1", "yes", "on", "false", "0", "no", "off"):
                found[key] = plain.lower() in ("true", "1", "yes", "on")
        elif "int" in kinds[key]:
            if plain.isdigit() and (int(plain) or key not in POSITIVE):
                found[key] = int(plain)
        elif "tuple" in kinds[key]:
            parts = tuple(x for part in value.strip("[]").split(",") if (x := part.strip().strip('"')))
            if parts:
                found[key] = parts
        elif plain and (key not in CHOICES or plain.lower() in CHOICES[key]):
            found[key] = plain.lower() if key in CHOICES else plain
    return Settings(**found)


def merge(*layers: Settings) -> Settings:
    """Later layers over earlier ones."""
    out = DEFAULTS
    for layer in layers:
        out = replace(out, **{f.name: v for f in fields(Settings) if (v := getattr(layer, f.name)) is not None})
    return out


def render(settings: Settings) -> str:
    """What parse reads back: a line for each key that is set."""
    shown = lambda v: str(v).lower() if isinstance(v, bool) else ", ".join(v) if isinstance(v, tuple) else f'"{v}"' if isinstance(v, str) else str(v)
    return "".join(f"{f.name} = {shown(v)}\n" for f in fields(Settings) if (v := getattr(settings, f.name)) is not None)


def save(settings: Settings, path: str) -> None:
    """Write the keys that are set over those of the file, if there is one; its other lines, comments too, stay."""
    at = Path(path)
    old = at.read_text().splitlines() if at.exists() else []
    new = {f.name: v for f in fields(Settings) if (v := getattr(settings, f.name)) is not None}
    kept = [line for line in old if not any(getattr(parse(line), k) is not None for k in new)]
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("".join(f"{line}\n" for line in kept) + render(settings))


def load(*paths: str) -> Settings:
    """The defaults under each file's layer that exists, later ones over earlier ones."""
    return merge(*[parse(Path(p).read_text()) for p in paths if Path(p).exists()])
