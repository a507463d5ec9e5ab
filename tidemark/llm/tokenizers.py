"""Byte-level BPE vocabularies given by path; nothing is trained or copied here."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import tiktoken

#: Default vocabularies; every operator takes another path as a parameter.
PACKING_VOCABULARY = "byte_bpe_50k.json"
ENCODING_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


def _unmapped() -> dict[str, int]:
    """Printable stand-ins of the byte-level JSON vocabularies -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def token_bytes(path: str) -> dict[int, bytes]:
    """id -> bytes of a rank file or of a byte-level JSON vocabulary, without added tokens."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return {int(i): base64.b64decode(t) for t, i in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, back = {t["content"] for t in spec["added_tokens"]}, _unmapped()
    return {i: bytes(back[ch] for ch in t) for t, i in spec["model"]["vocab"].items() if t not in special}


@lru_cache(4)
def added_tokens(path: str) -> dict[str, int]:
    """text -> id of the tokens that a JSON vocabulary finds in texts before anything else."""
    if path.endswith(".tiktoken"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of one worker process. In these vocabularies the id is the merge rank,
    so a JSON vocabulary and its rank file give the same ids, but for added tokens."""
    ranks = {t: i for i, t in token_bytes(path).items()}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))
