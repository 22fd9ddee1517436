"""Operators of a training-data pipeline over whole corpora; nothing else in the library imports this subpackage."""

from .bpe import op3_byte_bpe
from .decontamination import op10_decontamination
from .html import op1_html_extraction
from .lexical import SQL as _LEXICAL_SQL
from .lexical import op11_lexical_search
from .neardup import op5_minhash_neardup
from .quality import op7_quality_rules
from .resampling import op13_importance_resampling
from .rollups import SQL as _ROLLUP_SQL
from .rollups import op8_token_counts
from .secrets import op4_secret_scan
from .shards import op2_training_order
from .suffixes import op6_suffix_dedup
from .toxicity import op9_toxicity
from .vectors import op12_embedding_neardup

_ALL = (
    op1_html_extraction,
    op2_training_order,
    op3_byte_bpe,
    op4_secret_scan,
    op5_minhash_neardup,
    op6_suffix_dedup,
    op7_quality_rules,
    op8_token_counts,
    op9_toxicity,
    op10_decontamination,
    op11_lexical_search,
    op12_embedding_neardup,
    op13_importance_resampling,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {**_ROLLUP_SQL, **_LEXICAL_SQL}
