"""Words of a batch of texts, each distinct one once, and an existing tokenizer's pieces for them.

A word is a maximal run of characters that aren't white space.  The vocabulary's pieces never
reach over white space, so a text's pieces are those of its words; a batch's distinct words are
looked at once, however often they occur.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The default vocabulary; every operator takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def distinct_words(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place of each word among them, row offsets); nulls have no words.

    The empty string is among the distinct words where a text begins or ends with white space."""
    lists = pc.utf8_split_whitespace(pc.fill_null(col.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), offsets - offsets[0]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by row; a row may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def token_counts(col: pa.Array, vocabulary: str) -> np.ndarray:
    """Number of tokens of each text."""
    words, at, offsets = distinct_words(col)
    sp = processor(vocabulary)
    per_word = np.zeros(len(words), np.int64)
    for start in range(0, len(words), 50_000):
        part = words[start : start + 50_000].to_pylist()
        per_word[start : start + len(part)] = [len(x) for x in sp.encode(part, num_threads=1)]
    per_word[np.asarray(pc.equal(words, ""))] = 0
    return row_sums(per_word[at], offsets)
