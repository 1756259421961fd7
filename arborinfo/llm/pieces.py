"""The vocabulary of a sentencepiece model as arrays, and the words between which no piece reaches."""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """Normal pieces of the model file at ``path`` with their ids and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        odd = [i for i in ids if model.is_unused(i)]
        self.normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.piece = {model.id_to_piece(i): i for i in self.normal}
        self.text = {i: piece for piece, i in self.piece.items()}
        self.score = {i: model.get_score(i) for i in self.normal}
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if odd or any(SPACE in p.lstrip(SPACE) for p in self.piece) or model.unk_id() in self.byte_id:
            raise ValueError("the model needs byte pieces, no unused pieces, and no space mark inside a piece")


def keys_of(text: str) -> list[str]:
    """Words of a text, each without the space mark before it.

    The text gets one space mark in front and one for every space; no piece has a mark after
    another character, so merges and segmentations never cross the borders of these words. Runs
    of marks stay in one word.
    """
    if not text:
        return []
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [t[1:] for t in _TOKEN.findall(SPACE + text.replace(" ", SPACE))]


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words in a row, and the number of each word's."""
    joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, np.fromiter(map(len, words), np.int64, len(words))


def utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
