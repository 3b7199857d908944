"""Work of the SentencePiece encoder on short texts: the same ids, no pair looked at twice."""

import random

import public_tokenizers

from gapweave.llm import sentencepiece_bpe


def test_short_texts_look_at_each_pair_once(monkeypatch):
    c = sentencepiece_bpe.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(3)
    letters = sorted(x for x in c.known if x.isascii() and x.isalpha())
    texts = ["▁" + "".join(draw.choices(letters, k=draw.randint(1, 30))) for _ in range(400)]
    got = [list(c.backtrack(t)) for t in texts]
    calls, fit = [], c.fit
    monkeypatch.setattr(c, "fit", lambda a, b: calls.append((a, b)) or fit(a, b))
    assert [list(c.backtrack(t)) for t in texts] == got and not calls
    monkeypatch.setattr(sentencepiece_bpe, "SHORT_CHARS", 0)
    assert [list(c.backtrack(t)) for t in texts] == got
    assert [[c.id[p] for p in c.merged(t)] for t in texts] == got
