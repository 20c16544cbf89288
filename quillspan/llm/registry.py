"""Queries of this subpackage, and SQL for those that SQL can express."""

from quillspan.llm.collocations import OP13_SQL, op13_collocations
from quillspan.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from quillspan.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from quillspan.llm.importance_resampling import OP12_SQL, op12_importance_resampling
from quillspan.llm.jaccard_join import op8_jaccard_join
from quillspan.llm.line_dedup import OP4_SQL, op4_line_dedup
from quillspan.llm.mixing import OP5_SQL, op5_mixing
from quillspan.llm.quality_rules import OP7_SQL, op7_quality_rules
from quillspan.llm.sentencepiece_codec import op6_sentencepiece
from quillspan.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from quillspan.llm.toxicity import op3_toxicity
from quillspan.llm.url_filters import op10_url_filters
from quillspan.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op5_mixing": op5_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_warc": op9_warc,
    "op10_url_filters": op10_url_filters,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_quality_rules": OP7_SQL,
    "op5_mixing": OP5_SQL,
    "op9_warc": OP9_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
