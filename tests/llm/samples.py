"""Texts and names that several tests use."""

import random

# The queries' own columns and the operators' inner names, as extra columns of an input.
CLASHES = [
    "sig", "text_key", "component_id", "size", "target", "copies", "taken", "score", "rejected", "lang_pred", "item",
    "w", "h", "pos", "n_words", "spans", "bitmap", "n_dropped", "fingerprint", "chunk", "ahead", "_row", "_id", "_key", "host", "key",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(900)}" for _ in range(n))
