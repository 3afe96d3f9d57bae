"""Token ids of a byte-level BPE tokenizer file, computed by tiktoken on the vocabulary of that file.

The ids are those of tokenizers' Tokenizer.from_file(path).encode(text, add_special_tokens=False); tests hold the two
against each other. The file is read once, on the driver, and sent to the executors: its size is that of a vocabulary.
"""

from __future__ import annotations

import json
import re

# The published pattern of this kind of tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern's \\s has it, in runs too long for a backtracking matcher's stack.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Such vocabularies write bytes that aren't printable as characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(holder: dict):
    """A function text -> ids. holder["file"] is the file's content; the encoder is kept in holder, which a worker
    process has once for all its tasks."""
    if "encode" not in holder:
        import tiktoken

        content = json.loads(holder["file"])
        table = _byte_of_char()
        special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        ranks = {bytes(table[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = tuple(special)

        def short(text: str) -> list[int]:
            if any(name in text for name in names):
                return encoding.encode(text, allowed_special="all")
            return encoding.encode_ordinary(text)

        def encode(text: str) -> list[int]:
            """A long run of white space is one piece of the pattern, less its last character if text follows: so the
            text is cut there, and the matcher never sees the run."""
            out, at = [], 0
            for run in _RUN.finditer(text):
                end = run.end() - (run.end() < len(text))
                out += short(text[at : run.start()])
                out += encoding._encode_single_piece(text[run.start() : end].encode())
                at = end
            return out + short(text[at:]) if at else short(text)

        holder["encode"] = encode
    return holder["encode"]


def broadcast_file(spark, path: str | None = None):
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"file": f.read()})
