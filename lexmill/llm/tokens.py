"""Token ids of texts by a public byte-level BPE file, for other operators."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: End-of-document id of op2's contract.
END_ID = 2


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file; operators take any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level BPE files: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to a list of ids, as the ``tokenizers`` library gives them
    for the file at ``path`` without special tokens; strings of special tokens in a
    text count as ordinary text.

    A plain byte-level BPE file whose merges stand in the order of their ids goes to
    ``tiktoken``, which gives the same ids several times faster; other files go to
    ``tokenizers``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    letters = _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (
        model["type"] == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not model.get("ignore_merges")
        and all(all(ch in letters for ch in k) for k in vocab)
        and [vocab.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
    )
    if plain:
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {bytes(letters[ch] for ch in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids_of(path: str, text: str | None, end_id: int | None = END_ID) -> np.ndarray:
    """Ids of one text, null counting as empty, then ``end_id``."""
    ids = encoder(path)(text) if text else []
    if end_id is not None:
        ids.append(end_id)
    return np.array(ids, dtype="<u4")
