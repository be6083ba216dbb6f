"""The queries of this subpackage, and SQL for those that SQL can express."""

from matchloom.llm import chat, fingerprints, infill, langid, mixing, pages, pieces, repeats, secrets, sharding, simhash, spelling, vectors

QUERIES = {
    f.__name__: f
    for f in (
        fingerprints.op1_fingerprints, mixing.op2_mixing, secrets.op3_secrets, simhash.op4_simhash, pieces.op5_sentencepiece,
        repeats.op6_repeats, chat.op7_chat, vectors.op8_near_vectors, langid.op9_language_id, sharding.op10_sharding,
        pages.op11_pages, spelling.op12_spelling, infill.op13_infill,
    )
}
SQL = {"op2_mixing": mixing.SQL, "op7_chat": chat.SQL, "op10_sharding": sharding.SQL, "op12_spelling": spelling.SQL, "op13_infill": infill.SQL}
