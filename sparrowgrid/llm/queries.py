"""The queries of this subpackage by name, and the SQL that states the same result where SQL can."""

from .bpe import op6_bpe
from .divergence import OP12_SQL, op12_divergence
from .filters import OP11_SQL, op11_filters
from .fingerprint import op4_fingerprints
from .licenses import op9_licenses
from .lines import OP2_SQL, op2_lines
from .mixing import OP1_SQL, op1_mix_sources
from .quality import op5_quality
from .search import OP8_SQL, op8_topk
from .sharding import op10_shards
from .simhash import op7_simhash
from .suffixes import op3_suffixes
from .tokenfile import op13_token_files

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_lines": op2_lines,
    "op3_suffixes": op3_suffixes,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_topk": op8_topk,
    "op9_licenses": op9_licenses,
    "op10_shards": op10_shards,
    "op11_filters": op11_filters,
    "op12_divergence": op12_divergence,
    "op13_token_files": op13_token_files,
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op2_lines": OP2_SQL, "op8_topk": OP8_SQL, "op11_filters": OP11_SQL, "op12_divergence": OP12_SQL}
