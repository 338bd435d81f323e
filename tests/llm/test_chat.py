"""Reply trees against plain recursion: forks, ties, orphans, circles, repeated messages, null conversations."""

import random

from parcelkit.llm import chat

KIND = "conv_id long, node long, parent long, role string, text string, score double"


def plain(rows, best):
    """{(conv, branch): turns}"""
    convs = {}
    for conv, node, parent, role, text, score in rows:
        known = convs.setdefault(conv, {})
        new = (parent is not None, parent if parent is not None else -1, role or "", text or "", score or 0.0)
        known[node] = min(known.get(node, new), new)
    out = {}
    for conv, nodes in convs.items():
        parents = {m[1] for n, m in nodes.items() if m[0]}
        paths = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][1] if nodes[at][0] else None
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[n][4] for n in path), -len(path), leaf, path[::-1]))
        for k, (_, _, _, path) in enumerate(sorted(paths)[:best], 1):
            out[conv, k] = [(nodes[n][2], nodes[n][3]) for n in path]
    return out


def rows():
    rng = random.Random(8)
    made = [
        (1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", None), (1, 5, 3, "user", "d", 0.0),  # a fork and a tie
        (2, 1, 99, "user", "orphan", 1.0), (2, 2, 1, None, None, 1.0), (2, 3, None, "user", "another root", 9.0),
        (3, 1, 2, "a", "circle", 1.0), (3, 2, 1, "b", "circle", 1.0), (3, 3, 2, "c", "below", 1.0), (3, 4, None, "d", "apart", -5.0),
        (4, 1, 1, "a", "own parent", 1.0),
        (None, 1, None, "user", "no conversation", 1.0), (None, 2, 1, "assistant", "yes", 1.0),
        (5, 1, None, "user", "x", 1.0), (5, 1, None, "user", "w", 1.0), (5, 1, 7, "user", "a", 1.0),
    ]
    made += [(6, k, k - 1 if k > 1 else None, "user", f"m{k}", 0.5) for k in range(1, 78)] + [(6, 100 + k, k, "assistant", f"side {k}", float(k % 7)) for k in range(1, 78)]
    for conv in range(10, 30):
        made += [(conv, n, rng.randrange(n) if n and rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), f"t{n}", float(rng.randrange(4))) for n in range(rng.randrange(1, 40))]
    return made


def test_branches(spark):
    tree = spark.createDataFrame(rows(), KIND)
    for best in (1, 3, None):
        got = {(r.conv_id, r.branch): [tuple(t) for t in r.turns] for r in chat.branches(tree, best=best).collect()}
        assert got == plain(rows(), best)


def test_empty_and_read_back(spark):
    tree = spark.createDataFrame([], KIND)
    assert chat.branches(tree).count() == 0
    said = "\\l </turn>\n<turn user>\n # > \\\\ é"
    tree = chat.linear_tree(spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, None, None, None)], "conv_id long, turn long, role string, text string"))
    r = chat.read_back(chat.formatted(chat.branches(tree))).head()
    assert [(t.role, t.text) for t in r.turns_read] == [("", ""), ("user", said), ("assistant", said), ("assistant", said)] and r.loss_text == said + said
