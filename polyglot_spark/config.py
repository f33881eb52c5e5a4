"""Engine configuration.  Defaults follow the behaviour this engine is compatible with; switches offer stricter rules."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    #: longest block text in UTF-16 units; longer blocks are left alone ("drop") or cut into sentences ("split")
    max_block_chars: int = 3000
    oversize_block: str = "drop"
    #: a text of at least this many UTF-16 units is translated sentence by sentence
    split_min_chars: int = 120
    #: most words and characters of a glossary phrase
    short_words: int = 2
    short_chars: int = 30
    #: a unit is corrected for fluency only above this many words
    fluency_min_words: int = 3
    #: most words and characters of an interface command
    command_words: int = 4
    command_chars: int = 40
    confidence_threshold: float = 0.85
    weights: tuple[float, float, float] = (0.35, 0.35, 0.30)
    #: "all": a flagged unit is sent again, unsplit, whatever it came from; "model": glossary hits are kept
    retry_scope: str = "all"
    #: "emit": a rebuilt block is used as it is; "source": the source is kept when inline tokens were lost
    token_loss: str = "emit"
    #: "boundary": brands lie between ASCII word boundaries; "word": not within a word of any alphabet
    brand_edges: str = "boundary"
    #: "first": every token of a brand is restored to its first spelling; "each": each to its own
    brand_restore: str = "first"
    #: decode character references that lack their semicolon, as browsers do
    open_references: bool = True
    rtl_languages: tuple[str, ...] = ("arb_Arab",)
    #: "raw": hosts as written; "strict": bracketed IPv6 loopback and integer hosts are blocked too
    url_hosts: str = "raw"
    #: accept a repaired text that holds replacement characters
    mojibake_lossy: bool = True
    max_url_chars: int = 2048
    max_file_bytes: int = 5 * 1024 * 1024

    #: whether the pipeline runs its fluency and tone hooks, where it is given any
    fluency_correction: bool = True
    tone_normalization: bool = True

    @classmethod
    def from_settings(cls, spark, prefix: str = "spark.polyglot.") -> EngineConfig:
        """The defaults with what the session sets as ``spark.polyglot.<field>``; a switch is on only for "true" or "1"."""
        found = {}
        for field in fields(cls):
            value, default = spark.conf.get(prefix + field.name, None), field.default
            if value is not None:
                if isinstance(default, tuple):
                    found[field.name] = tuple(type(default[0])(v.strip()) for v in value.split(","))
                else:
                    found[field.name] = value in ("true", "1") if isinstance(default, bool) else type(default)(value)
        return cls(**found)

    def strict(self) -> EngineConfig:
        return replace(
            self, oversize_block="split", split_min_chars=800, fluency_min_words=2, retry_scope="model", token_loss="source",
            brand_edges="word", brand_restore="each", rtl_languages=("arb_Arab", "urd_Arab"), url_hosts="strict", mojibake_lossy=False,
        )


COMPATIBLE = EngineConfig()
