"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .classifier import op11_classifier
from .collocations import OP13_SQL, op13_collocations
from .decontam import OP10_SQL, op10_decontamination
from .html_text import op7_html
from .line_dedup import OP3_SQL, op3_line_dedup
from .pii import op4_pii
from .quality import OP8_SQL, op8_quality
from .sharding import OP1_SQL, op1_sharding
from .simhash import op2_simhash
from .spelling import OP12_SQL, op12_spelling
from .substring import op5_substring
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_substring": op5_substring,
    "op6_bpe": op6_bpe,
    "op7_html": op7_html,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_classifier": op11_classifier,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}
#: SQL has no XXH64, byte-level BPE, iterative bootstrapping, HTML or networks; tests hold op2, op4, op5, op6 and op7 against brute
#: force and op11 to its accuracy on held-out labels.
SQL = {"op1_sharding": OP1_SQL, "op3_line_dedup": OP3_SQL, "op8_quality": OP8_SQL, "op9_warc": OP9_SQL, "op10_decontamination": OP10_SQL, "op12_spelling": OP12_SQL, "op13_collocations": OP13_SQL}
