"""One query per operator, with production parameters, and SQL where SQL can say it."""

from lexmill.llm.conversations import OP11_SQL, op11_conversation_repair
from lexmill.llm.decontamination import OP9_SQL, op9_decontamination
from lexmill.llm.embedding_dedup import OP13_SQL, op13_embedding_dedup
from lexmill.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from lexmill.llm.language_id import op1_language_id
from lexmill.llm.packing import op2_packing
from lexmill.llm.passages import op10_passages
from lexmill.llm.pii import op5_pii
from lexmill.llm.token_counts import op4_token_counts
from lexmill.llm.url_filter import OP8_SQL, op8_url_filter
from lexmill.llm.vector_codes import OP12_SQL, op12_vector_codes
from lexmill.llm.vector_search import OP3_SQL, op3_vector_search
from lexmill.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_vector_search": op3_vector_search,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_passages": op10_passages,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_embedding_dedup": op13_embedding_dedup,
}
ORACLES = {
    "op3_vector_search": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_embedding_dedup": OP13_SQL,
}
