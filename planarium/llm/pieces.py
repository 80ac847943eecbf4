"""The pieces of a public SentencePiece BPE model, and text cut where no piece can cross.

No piece of such a vocabulary holds the space mark after another character (checked on loading). No merge can cross
from a word into the space before the next, so each run of spaces with the word behind it is merged by itself, and
equal runs need be merged only once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

MARK = "▁"
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Pieces:
    """ids: piece -> id; ranks: piece -> rank, lower first; ties of score have equal ranks and merge from the left."""

    ids: dict[str, int]
    ranks: dict[str, int]
    byte_ids: tuple[int, ...]
    size: int

    def spelled(self) -> list[bytes]:
        """By id, the bytes that a piece stands for; pieces that stand for none (control, unknown) are empty."""
        out = [b""] * self.size
        for piece, k in self.ids.items():
            out[k] = piece.replace(MARK, " ").encode()
        for value, k in enumerate(self.byte_ids):
            out[k] = bytes([value])
        return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def load(path: str | None = None) -> Pieces:
    """Read a .model file on the driver. Raise ValueError where its settings are not those that the operators assume."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path or default_model(), "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, {1: [], 6: []}
    for k, p in enumerate(model.pieces):
        kinds.setdefault(p.type, []).append((p.piece, p.score, k))
    normal = kinds[1]
    if norm.name != "identity" or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("the model changes its texts before it cuts them")
    if kinds.keys() & {4, 5} or len(kinds[6]) != 256 or not isinstance(sentencepiece.__version__, str):
        raise ValueError("the model has user-defined or unused pieces, or no byte pieces")
    known = {p for p, _, _ in normal}
    if any(c not in known for p in known for c in p) or any(re.search(f"[^{MARK}]{MARK}", p) for p in known):
        raise ValueError("a piece crosses from a word into a space, or holds a character that is no piece")
    order = {s: r for r, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
    return Pieces(
        {p: k for p, _, k in normal},
        {p: order[s] for p, s, _ in normal},
        tuple(k for _, _, k in sorted(kinds[6])),
        len(model.pieces),
    )


def runs(text: str) -> list[str]:
    """The text with the mark put before it and for each space, cut into runs that merge independently."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")  # by far the most texts; each part stands for the mark and itself
    return _RUNS.findall(MARK + text.replace(" ", MARK))


def marked(run: str) -> str:
    """A part from runs() with its mark."""
    return run if run.startswith(MARK) else MARK + run
