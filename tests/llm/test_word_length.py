import numpy as np

from graphloom.llm import quality


def test_overlong_words_score_worse(words):
    s = np.array([quality.text_statistics(words(80 + i, i)) for i in range(400)] + [quality.text_statistics(" ".join(w * 8 for w in words(90, 7).split()))])
    score = quality.grow(quality.shares(s), 100, 256).score(quality.shares(s))
    assert score.argmax() == 400 and score[400] > np.median(score) + 0.05
