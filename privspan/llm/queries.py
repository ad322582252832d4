"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from . import bpe, embedding_dedup, exact_dedup, language, licenses, lloyd, mixing, quality, simhash, suffix_dedup, token_files, warc, whitening

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_quality_neighbours": quality.op3_quality_neighbours,
    "op4_suffix_repeats": suffix_dedup.op4_suffix_repeats,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash_golay": simhash.op6_simhash_golay,
    "op7_embedding_lattice": embedding_dedup.op7_embedding_lattice,
    "op8_language_crf": language.op8_language_crf,
    "op9_license_minhash": licenses.op9_license_minhash,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_lloyd": lloyd.op12_lloyd,
    "op13_token_files": token_files.op13_token_files,
}

SQL = {
    "op5_mixing": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_lloyd": lloyd.SQL,
}
