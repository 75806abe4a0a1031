"""Alignments take scores from one table."""

import random

import pytest

from orbitframe.operators import sequences as q


@pytest.mark.parametrize("trace_bytes", [1 << 25, 64])
def test_scores_of_plain_letters_are_looked_up(monkeypatch, trace_bytes):
    """The same alignments as by scores of any script, which are made once for each stretch of the way back, not for each antidiagonal."""
    r = random.Random(3)
    pairs = [("".join(r.choices("ACDEFGWBZ-", k=r.randrange(60))), "".join(r.choices("ACDEFGWBZ-", k=r.randrange(1, 60)))) for _ in range(40)]
    calls, plain = [], q.scores
    monkeypatch.setattr(q, "scores", lambda a, b: calls.append(len(a)) or plain(a, b))
    found = [q.align(a, b, trace_bytes) for a, b in pairs]
    n = len(calls)
    made = q.Diagonals.__init__

    def other(self, x, y):
        made(self, x, y)
        self.ascii = False

    monkeypatch.setattr(q.Diagonals, "__init__", other)
    assert found == [q.align(a, b, trace_bytes) for a, b in pairs]
    assert n <= sum(1 + (len(a) + len(b)) // 4 for a, b in pairs) and len(calls) - n > 2 * n
