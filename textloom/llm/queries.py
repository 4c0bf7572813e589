"""The training-data queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .ann_graph import op10_ann_graph
from .chat_format import OP13_SQL, op13_chat_format
from .decontamination import OP9_SQL, op9_decontamination
from .filter_interactions import OP11_SQL, op11_filter_interactions
from .importance_resampling import OP12_SQL, op12_importance_resampling
from .language_id import op1_language_id
from .license_scan import op7_license_scan
from .line_dedup import OP6_SQL, op6_line_dedup
from .lm_scoring import op8_lm_scoring
from .minhash_forest import OP4_SQL, op4_minhash_forest
from .sentencepiece_sampling import op3_sentencepiece
from .token_counts import op2_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_sentencepiece,
        op4_minhash_forest,
        op5_toxicity,
        op6_line_dedup,
        op7_license_scan,
        op8_lm_scoring,
        op9_decontamination,
        op10_ann_graph,
        op11_filter_interactions,
        op12_importance_resampling,
        op13_chat_format,
    )
}

#: The others have no twin: SQL can't express their models, samples and approximations.
ORACLE_SQL: dict[str, str] = {"op4_minhash_forest": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_decontamination": OP9_SQL, "op11_filter_interactions": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_chat_format": OP13_SQL}
