"""Token ids of whole texts under a byte-level BPE vocabulary file."""

from __future__ import annotations

import json


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted({*range(256)} - {*shown})
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file, the same as the `tokenizers` library gives without special tokens added.

    The vocabulary is read from the library's own file; the merges run by rank. A special token's string in a text
    becomes that token, as in the library.
    """

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("from_file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str):
        """The ids of a text, an array of unsigned 32-bit numbers."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")
