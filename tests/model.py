"""A log as plain Python: the meaning that the Spark operators must have."""

import random


def visible(log, as_of=None):
    """{key: (seq, value)} of the live keys."""
    newest = {}
    for key, seq, vtype, value in log:
        if (as_of is None or seq <= as_of) and (key not in newest or newest[key][0] < seq):
            newest[key] = (seq, vtype, value)
    return {k: (s, v) for k, (s, t, v) in newest.items() if t == 1}


def prune(log, oldest):
    """Versions in internal order; one goes if the version before it is visible at ``oldest``."""
    out, last = [], {}
    for row in sorted(log, key=lambda r: (r[0], -r[1])):
        key, seq = row[:2]
        if key not in last or last[key] > oldest:
            out.append(row)
        last[key] = seq
    return out


def random_log(seed, n=300, keys=25):
    r = random.Random(seed)
    names = [bytes(r.randrange(256) for _ in range(r.randint(0, 3))) for _ in range(keys)]
    out = []
    for seq in range(1, n + 1):
        dead = r.random() < 0.3
        out.append((r.choice(names), seq, 0 if dead else 1, None if dead else bytes(r.randrange(256) for _ in range(r.randint(0, 4)))))
    return out
