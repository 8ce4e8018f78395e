"""The registered queries of this subpackage."""

from kgloom.llm.debruijn import SQL as PASSAGES_SQL
from kgloom.llm.debruijn import op13_passages
from kgloom.llm.decontamination import op2_decontamination
from kgloom.llm.jaccard import op4_jaccard
from kgloom.llm.language import op9_language
from kgloom.llm.licenses import op6_licenses
from kgloom.llm.packing import op10_packing
from kgloom.llm.phrases import SQL as PHRASES_SQL
from kgloom.llm.phrases import op12_phrases
from kgloom.llm.pii import op5_pii
from kgloom.llm.pivots import op3_embeddings
from kgloom.llm.quality import op8_quality
from kgloom.llm.sharding import op1_shards
from kgloom.llm.substrings import op7_substrings
from kgloom.llm.tries import SQL as CONVERSATIONS_SQL
from kgloom.llm.tries import op11_conversations

QUERIES = {f.__name__: f for f in (op1_shards, op2_decontamination, op3_embeddings, op4_jaccard, op5_pii, op6_licenses, op7_substrings, op8_quality, op9_language, op10_packing, op11_conversations, op12_phrases, op13_passages)}
ORACLES: dict[str, str] = {"op11_conversations": CONVERSATIONS_SQL, "op12_phrases": PHRASES_SQL, "op13_passages": PASSAGES_SQL}
