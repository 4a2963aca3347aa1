"""Settings: text-search language, content budget in bytes, ranking profile."""

from __future__ import annotations

from dataclasses import dataclass, replace

from textrill.errors import UnsupportedEngine

DEFAULT_BYTES = 2_097_152
PROFILES = ("fts5", "tsquery", "boolean")
#: What one tsquery vector holds.
VECTOR_BYTES = 1_048_575
#: Languages on offer. "simple" cuts words without stemming; no other is built in.
LANGUAGES = ("simple",)


def offered(languages=LANGUAGES) -> list[str]:
    """The languages on offer: "simple" first, the others by name."""
    return sorted(set(languages), key=lambda x: (x != "simple", x))


@dataclass(frozen=True)
class Config:
    language: str = "simple"
    content_bytes: int = DEFAULT_BYTES
    profile: str = "fts5"
    #: Most bytes of distinct words a document may bring into the index; more text is halved. None for no limit.
    ceiling_bytes: int | None = None
    #: Whether tsquery ranks by cover density with title weights; by BM25 otherwise.
    cover_density: bool = True
    #: Settings as they were stored: an unknown profile is told by the health card and refused by searches.
    lenient: bool = False

    def __post_init__(self):
        # a stored value that no longer holds falls back instead of breaking every search
        if self.language not in LANGUAGES:
            object.__setattr__(self, "language", "simple")
        object.__setattr__(self, "content_bytes", max(1, int(self.content_bytes)))
        if self.profile not in PROFILES and not self.lenient:
            raise UnsupportedEngine(self.profile)
        if self.ceiling_bytes is None and self.profile == "tsquery":
            object.__setattr__(self, "ceiling_bytes", VECTOR_BYTES)

    def with_language(self, language: str) -> Config:
        if language not in LANGUAGES:
            raise ValueError(f"language not on offer: {language}")
        return replace(self, language=language)

    def with_content_bytes(self, content_bytes: int) -> Config:
        if not isinstance(content_bytes, int) or content_bytes <= 0:
            raise ValueError("content_bytes must be above 0")
        return replace(self, content_bytes=content_bytes)
