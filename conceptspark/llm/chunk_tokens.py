"""Token counts of huge documents by overlap resynchronisation.

A long text is encoded in overlapping chunks. Each encoding yields the offsets of its token boundaries. Two neighbouring
chunks are spliced at a boundary that both have and that is proven stable: the two characters around it stand together in
no piece of the vocabulary, so no merge can cross it, whatever surrounds it. Where an overlap holds no such boundary it
is widened, in the end to the rest of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from conceptspark.llm.common import boolean, long, per_text, tokenizer_file

MODEL = "piece_bpe_32k.model"
CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
SPACE = "▁"


class ChunkCounter:
    """Counts the tokens of a sentencepiece BPE model with byte fallback, as ``encode`` gives them.

    ``chunk`` and ``overlap`` are in code points; they bound memory and do not change a count.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import numpy as np
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, max(2, min(overlap, chunk // 2))
        n = self.sp.get_piece_size()
        widths, self.pairs = np.zeros(n, np.int64), set()
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                # the bytes of a character: the first stands for it, the others add nothing
                widths[i] = not 0x80 <= int(piece[3:5], 16) < 0xC0
            else:
                widths[i] = len(piece)
                self.pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self.widths = widths
        # a normaliser that changes lengths would shift offsets; such models are encoded whole
        probe = "a  b é́Ａ\t c "
        self.keeps_length = self._ends(probe)[-1] == len(probe)

    def _ends(self, text: str):
        """Offset in ``text`` at which each token ends; the model puts one space before a text."""
        ids = self.sp.encode(text, num_threads=1)
        return self.widths[ids].cumsum() - 1

    def _stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.pairs

    def _splice(self, text: str, low: int, left, right) -> int | None:
        """Last common stable boundary above ``low``; ``left`` and ``right`` are sorted offsets."""
        import numpy as np

        common = np.intersect1d(left, right)
        for at in common[common > low][::-1].tolist():
            if at < len(text) and self._stable(text, at):
                return at
        return None

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.keeps_length:
            return len(self.sp.encode(text, num_threads=1))
        # tokens up to ``done`` are counted; ``ends`` are the boundaries of text[start:stop] and hold from ``done`` on
        total, done, start, span, overlap = 0, -1, 0, self.chunk, self.overlap
        stop = span
        ends = self._ends(text[:stop])
        while stop < len(text):
            begin = stop - overlap
            if begin <= max(start, done):
                # no stable boundary in the rest of this chunk: encode a longer one
                span, overlap = 2 * span, self.overlap
                stop = min(len(text), start + span)
                ends = self._ends(text[start:stop]) + start
                continue
            following = self._ends(text[begin : begin + self.chunk + overlap]) + begin
            at = self._splice(text, begin, ends, following)
            if at is None:
                overlap *= 2
                continue
            total += int(((ends > done) & (ends <= at)).sum())
            done, start, stop, ends = at, begin, min(len(text), begin + self.chunk + overlap), following
            span, overlap = self.chunk, self.overlap
        return total + int((ends > done).sum())


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Per input row: UTF-8 bytes, tokens of the whole text, and whether they exceed ``limit``.

    A null text counts as empty: 0 bytes, 0 tokens, within the limit. Equal rows give equal rows, a null id stays null, other
    columns of ``docs`` are not read, and an empty table gives an empty table.
    """

    def make():
        counter = ChunkCounter(path or tokenizer_file(MODEL), chunk, overlap)

        def work(texts):
            texts = [t or "" for t in texts]
            tokens = [counter.count(t) for t in texts]
            return [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]

        return work

    return per_text(docs, make, [long("n_bytes"), long("n_tokens"), boolean("over_limit")], text_col, [id_col])
