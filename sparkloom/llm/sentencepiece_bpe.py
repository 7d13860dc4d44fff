"""SentencePiece encoding and decoding for BPE models with byte fallback, by prefix tables (token_tables.py).

The text becomes the library's internal form (spaces as U+2581, one put in front of a text that is not empty) and is cut
where no piece of the vocabulary reaches across, so that merges cannot cross either: before a run of U+2581, and between
letters and other characters if the model allows it (checked piece by piece when it is loaded). Each part is encoded by
its prefix table; a memo of bounded size holds the parts that occur often. Texts are whole; nothing is shuffled.

Defined results: null text counts as empty; an empty text gives begin and end only; characters outside the vocabulary
give byte pieces, or the unknown id where the model has no byte pieces. Ids pass through in any type; an empty table gives
no rows; other columns are ignored. Only models with an identity normaliser are accepted; any other raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .token_tables import MEMO, PrefixTable

MARK = "▁"
#: Cuts between letters and other characters as well as before spaces; and before spaces only.
FINE = re.compile(f"{MARK}*[^\\W\\d_²]+|{MARK}*(?:(?![^\\W\\d_²])[^{MARK}])+|{MARK}+")
COARSE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class SentencePieceBpe:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if train.model_type != train.BPE or not plain or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave the text as it is are supported")
        kinds = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size, self.bos, self.eos, self.unk = kinds.get_piece_size(), kinds.bos_id(), kinds.eos_id(), kinds.unk_id()
        surface, score, self.byte, self.shown = {}, {}, {}, []
        for i in range(self.size):
            piece = kinds.id_to_piece(i)
            if kinds.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte[b] = i
                self.shown.append(chr(b) if b < 128 else chr(0xDC00 + b))  # the latter as in surrogateescape
            elif kinds.is_control(i):
                self.shown.append("")
            elif kinds.is_unknown(i):
                self.shown.append(train.unk_surface)
            else:
                surface[i], score[i] = piece, kinds.get_score(i)
                self.shown.append(piece.replace(MARK, " "))
        by_surface = {s: i for i, s in surface.items()}

        def rank(a: int, b: int):
            t = by_surface.get(surface[a] + surface[b])
            return None if t is None else (-score[t], t)

        for s in [s for s in {c for s in surface.values() for c in s} if s not in by_surface]:
            raise ValueError(f"the vocabulary has {s!r} only inside pieces")
        self.table = PrefixTable(surface, rank)
        self.part = FINE if all(FINE.fullmatch(s) for s in surface.values()) else COARSE
        self.no_cut = not all(self.part.fullmatch(s) for s in surface.values())
        self.known = set(by_surface)
        self.memo: dict[str, tuple[int, ...]] = {}

    def _part(self, part: str) -> tuple[int, ...]:
        ids: list[int] = []
        start = 0
        for k, c in () if self.known.issuperset(part) else enumerate(part):
            if c not in self.known:
                ids += self.table.encode(part[start:k])
                ids += [self.byte[b] for b in c.encode()] if self.byte else [self.unk]
                start = k + 1
        ids += self.table.encode(part[start:])
        if len(self.memo) >= MEMO:
            self.memo.clear()
        out = tuple(ids)
        if len(part) <= 64:
            self.memo[part] = out
        return out

    def encode(self, text: str) -> list[int]:
        """Ids without begin and end."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        if self.no_cut:
            return list(self._part(text))
        parts = self.part.findall(text)
        found = list(map(self.memo.get, parts))
        if None in found:
            found = [self._part(p) if f is None else f for p, f in zip(parts, found)]
        return list(chain.from_iterable(found))

    def decode(self, ids) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        if text[:1] == " ":
            text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            text = re.sub("[\udc80-\udcff]+", lambda m: m[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), text)
        return text


@cache
def loaded(model_file: str) -> SentencePieceBpe:
    return SentencePieceBpe(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens (all ids, begin and end included), ids_sha256, decoded_sha256; the ids on request."""
    fields = [f"doc_id {docs.schema[id_col].dataType.simpleString()}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]

    def run(batches):
        model = loaded(model_file)
        for batch in batches:
            counts, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = [model.bos, *model.encode(text.as_py() or ""), model.eos]
                packed = array("I", ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), ", ".join(fields + ["ids array<int>"] * with_ids))


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids. Null or no ids give an empty text; repeated rows equal texts; doc_id may be
    null and of any type; an empty table gives no rows; other columns are ignored."""

    def run(batches):
        model = loaded(model_file)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


