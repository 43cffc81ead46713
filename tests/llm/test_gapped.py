"""Insults with a character, a mark or a space between all their letters."""

import numpy as np

from geoplane.llm import toxicity


def test_fully_gapped_insults():
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice("the of and to in that was for with hand stone river about under great".split(), 30)) for _ in range(60)]
    words = ["idiot", "moron", "trash", "loser", "worthless"]
    model = toxicity.Model([f"the {w} of that river. {t}" for t, w in zip(clean[:30], words * 6)], clean[30:])
    gapped = [f"you {gap.join(w)}!" for w in words for gap in ("-", ".", "x", " ", "--")]
    scores = model.score(gapped)
    assert [t for t, s in zip(gapped, scores) if s < 0.5] == []
    assert max(model.score(["the g-r-e-a-t river", "the g r e a t river", "a b c d", "under-the-great-stone"])) < 0.5
