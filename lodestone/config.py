"""Engine configuration: every extension point of the engine is a field here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

# English stopwords that never become index terms.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other our ours
    ourselves out over own same she should so some such than that the their theirs them themselves then there these they
    this those through to too under until up very was we were what when where which while who whom why with would you your
    yours yourself yourselves
    """.split()
)
# Words that never become synonym candidates.
NOISE_WORDS = tuple(
    """
    within without instead about around between through during before after above below under over here there where what
    when which who whom whose this that these those some any every each both all much many more most few several such own
    same other another else also very just only even still already yet once hereby herein thereof thereto thence whereby
    wherein whereas whereupon whosoever getting get got having doing being making taking going coming using based used
    given following regarding including excluding concerning according depending related known various certain specific
    particular multiple single available possible current general common typical standard regular normal simple basic
    major main primary key total full whole entire complete partial respective individual separate additional further
    furthermore moreover nevertheless nonetheless notwithstanding hence thus therefore consequently accordingly besides
    likewise similarly conversely rather
    """.split()
)
# Stopwords of the fallback retriever's own tokenizer.
FALLBACK_STOPWORDS = tuple(
    """
    a an the is are was were what how when where who why do does can could would should i me my you your we our they their
    it its to of in on for and or but
    """.split()
)
INTENTS = ("navigational", "transactional", "informational", "support")


def same(tokens: Column) -> Column:
    return tokens


@dataclass(frozen=True)
class EngineConfig:
    indexable_types: tuple[str, ...] = ("page", "post")
    stopwords: tuple[str, ...] = STOPWORDS
    noise_words: tuple[str, ...] = NOISE_WORDS
    #: Shortcode names that are removed, with their brackets, before tokenizing.
    shortcodes: tuple[str, ...] = ()
    #: Applied to an array of tokens after all other filters.
    token_filter: Callable[[Column], Column] = same
    k1: float = 1.5
    b: float = 0.75
    field_weights: dict[str, float] = field(default_factory=dict)
    #: Content tokens that are indexed, by post type; DEFAULT_CONTENT_CAP for other types.
    content_caps: dict[str, int] = field(default_factory=lambda: {"page": 2000})
    default_content_cap: int = 500
    intent_boosts: dict[str, dict[str, float]] = field(
        default_factory=lambda: {"navigational": {"page": 1.3}, "transactional": {"page": 1.0}, "informational": {"post": 1.3, "page": 1.0}, "support": {}}
    )
    default_synonyms: dict[str, list[str]] = field(default_factory=dict)
    synonym_expansion_limit: int = 6
    jaccard_threshold: float = 0.08
    synonym_sample: int = 200
    corpus_limit: int = 1000
    rebuild_batch_size: int = 50
    search_rate_limit: int = 60
    ip_rate_limit: int = 20
    conversation_rate_limit: int = 60
    breaker_threshold: int = 3
    #: Called when a rebuild has finished.
    on_rebuild_complete: tuple[Callable[[], None], ...] = ()

    def weights(self) -> dict[str, float]:
        """Field weights, defaults filled in."""
        return {"title": 3.0, "excerpt": 2.0, "content": 1.0} | self.field_weights

    def batch_size(self) -> int:
        return max(1, min(250, self.rebuild_batch_size))


DEFAULT = EngineConfig()
