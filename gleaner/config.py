"""Settings in sections, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields

from gleaner.operators.chunking import ChunkConfig
from gleaner.sources.files import DEFAULT_EXCLUDES


@dataclass
class IndexSettings:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    max_file_size: int = 50 << 20
    debounce_ms: int = 500
    buckets: int = 0  # 0: from the size
    strict_types: bool = False


@dataclass
class EmbeddingSettings:
    model: str = "hash"
    dim: int = 384
    batch_size: int = 32


@dataclass
class ChunkingSettings:
    target_size: int = 512
    max_size: int = 1024
    overlap: int = 64
    strategy: str = "auto"


@dataclass
class QuerySettings:
    default_limit: int = 10
    max_limit: int = 100
    hybrid: bool = True
    metric: str = "cosine"


@dataclass
class LoggingSettings:
    level: str = "WARN"


@dataclass
class Settings:
    index: IndexSettings = field(default_factory=IndexSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    chunking: ChunkingSettings = field(default_factory=ChunkingSettings)
    query: QuerySettings = field(default_factory=QuerySettings)
    logging: LoggingSettings = field(default_factory=LoggingSettings)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings of a TOML file; what it leaves out keeps its default, what is not known is an error."""
        with open(path, "rb") as f:
            data = tomllib.load(f)
        out = cls()
        for section, values in data.items():
            part = getattr(out, section, None)
            if part is None:
                raise ValueError(f"unknown section {section}")
            known = {x.name for x in fields(part)}
            for key, value in values.items():
                if key not in known:
                    raise ValueError(f"unknown setting {section}.{key}")
                setattr(part, key, value)
        return out

    def dump(self) -> str:
        """The settings as TOML."""
        text = lambda v: str(v).lower() if isinstance(v, bool) else repr(v).replace("'", '"')
        return "\n".join(f"[{s}]\n" + "".join(f"{k} = {text(v)}\n" for k, v in part.items()) for s, part in asdict(self).items())

    def chunk_config(self) -> ChunkConfig:
        return ChunkConfig(self.chunking.target_size, self.chunking.max_size, self.chunking.overlap)
