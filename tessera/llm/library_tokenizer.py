"""Token ids from a file of the `tokenizers` library, encoded once per distinct piece of text and worker."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

from tessera.llm.chunks import ChunkEncoder, cut_at_spaces, cut_marks, gather, text_of

#: Pieces that one call of the library gets.
JOINED = 2000
#: Share of the cache's bounds for files that drop white space: packing, the pipeline's last stage, works beside what
#: the stages before it have left of an executor's memory.
ROOM = 0.5
#: A line break or none and a single word of a byte-level split pattern: letters that every version of Unicode has as
#: such (to U+00FF), digits or marks, with a space before them or none.
_WORD = re.compile(rb"(\n?)( ?(?:(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++|[0-9]++|[!-/:-@[-`{-~]++))").fullmatch


def _white_space_pieces(texts: list[str]):
    """Pieces for a tokenizer that drops white space, as no token crosses a space or a line break."""
    return cut_at_spaces([cut_marks(t.replace("\n", " ")) for t in texts])


def _one_word(piece: str) -> bool:
    """Whether the library is sure to see a single word in a piece: letters that normalising leaves letters."""
    return piece.isalpha() and (piece.isascii() or is_normalized("NFC", piece) and piece.lower().isalpha())


def _byte_level_words(tokenizer) -> Callable[[list[bytes]], tuple[list[int], list[int]]] | None:
    """For a plain byte-level tokenizer: the ids of pieces that _WORD knows, one after another, and how many each has (0
    for a piece it does not know). The library's model gets the words in its byte alphabet, without the library's search
    for cuts."""
    cuts = tokenizer.pre_tokenizer
    added = tokenizer.get_added_tokens_decoder().values()
    if type(cuts).__name__ != "ByteLevel" or cuts.add_prefix_space or not cuts.use_regex or tokenizer.post_processor is not None or not all("<|" in t.content for t in added):
        return None
    from tessera.llm.bpe import byte_chars

    alphabet = {b: c for c, b in byte_chars().items()}
    model = tokenizer.model
    tokenize = model.tokenize
    model._resize_cache(0)  # words come once

    space, line = alphabet[32], [t.id for t in tokenize(alphabet[10])]

    def words(pieces: list[bytes]) -> tuple[list[int], list[int]]:
        flat: list[int] = []
        sizes: list[int] = []
        for p in pieces:
            held = len(flat)
            if p[1:].isalpha() and p[:1] == b" ":
                flat += [t.id for t in tokenize(space + p[1:].decode())]
            elif (m := _WORD(p)) is not None:
                broken, word = m.groups()
                flat += line if broken else []
                flat += [t.id for t in tokenize(word.decode("latin-1").translate(alphabet))]
            sizes.append(len(flat) - held)
        return flat, sizes

    return words


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """Encodes as Tokenizer.from_file(path) does with add_special_tokens=False. Byte-level files without a
    normaliser are cut as in bpe.BpeModel.cut; files that split on white space and drop it, at white space.

    In byte-level files single words are encoded by the library's model alone. Pieces whose first or last id shows itself
    are encoded many at a time, as one text: in byte-level files those with a space or line break before them and none
    within, in the others single words, whose last token has an end-of-word suffix. All other pieces are encoded one by
    one.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin or end a piece
    keeps_spaces = tokenizer.normalizer is None
    words = _byte_level_words(tokenizer) if keeps_spaces else None
    if keeps_spaces:
        from tessera.llm.bpe import model

        cut = model(path).cut
        edge[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True

        def together(pieces: list[bytes]) -> list[bool]:
            return [p[:1] in (b" ", b"\n") and not (t := text_of(p))[1:2].isspace() and not t[-1].isspace() for p in pieces]

        def joined_text(pieces: list[bytes]) -> str:
            return b"".join(pieces).decode()

        def plain(piece: str) -> str:
            return piece
    else:
        cut = _white_space_pieces
        edge[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

        def together(pieces: list[bytes]) -> list[bool]:
            return [_one_word(p.decode()) for p in pieces]

        def joined_text(pieces: list[bytes]) -> str:
            return (b" ".join(pieces) + b" ").decode()

        def plain(piece: str) -> str:
            return piece + " "

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, flat, and how many each has."""
        flat, sizes, done = [np.empty(0, np.int32)], [], np.zeros(len(pieces), bool)
        if words is not None:
            ids, each = words(pieces)
            each = np.array(each, np.int64)
            done = each > 0
            flat.append(np.array(ids, np.int32))
            sizes.append(each[done])
        left = np.flatnonzero(~done)
        many = np.array(together([pieces[i] for i in left.tolist()]), bool)

        def alone(group: list[bytes]) -> None:
            texts = [plain(text_of(p)) for p in group]
            each = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat.extend(np.array(x, np.int32) for x in each)
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))

        ready, joined, single = (x.tolist() for x in (np.flatnonzero(done), left[many], left[~many]))
        for start in range(0, len(joined), JOINED):
            group = [pieces[i] for i in joined[start : start + JOINED]]
            (found,) = tokenizer.encode_batch_fast([joined_text(group)], add_special_tokens=False)
            ids = np.array(found.ids, np.int32)
            at = np.flatnonzero(edge[ids])
            size = np.diff(at, append=len(ids)) if keeps_spaces else np.diff(at, prepend=-1)
            if len(size) == len(group) and size.sum() == len(ids):
                flat.append(ids)
                sizes.append(size)
            else:  # letters of which the library knows more or less
                alone(group)
        alone([pieces[i] for i in single])
        size, order = np.concatenate(sizes), np.array(ready + joined + single, np.int64)
        start, in_order = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        start[order], in_order[order] = np.cumsum(size) - size, size
        return gather(np.concatenate(flat), start, in_order), in_order

    return ChunkEncoder(cut, encode, 1 if keeps_spaces else ROOM)
