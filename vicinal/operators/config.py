"""Model configurations and trees: small JSON documents, parsed and checked on the driver."""

from __future__ import annotations

import json
import re

MOST_HOPS = 20
#: What a stanza inherits from the top level.
INHERITED = ("bases", "mutpats", "mutrates", "selpats", "selfactors", "selcoef", "fixfn", "fixfn.params", "initfreqs", "genmatrix")


def read(text: str) -> dict:
    """A configuration; selpats given as maps of weights become lists with selfactors."""
    return normalised(json.loads(text))


def normalised(config: dict) -> dict:
    config = {k: normalised(v) if isinstance(v, dict) and k not in ("selpats", "fixfn.params", "selcoef") else v for k, v in config.items()}
    pats = config.get("selpats")
    if isinstance(pats, dict):
        config.setdefault("selnames", list(pats))
        pats = list(pats.values())
    if pats and any(isinstance(p, dict) for p in pats):
        config["selfactors"] = [[float(x[0] if isinstance(x, list) else x) for x in p.values()] if isinstance(p, dict) else [1.0] * len(p) for p in pats]
        config["selpats"] = [list(p) for p in pats]
    elif pats is not None:
        config["selpats"] = pats
        config.setdefault("selfactors", [[1.0] * len(p) for p in pats])
    return config


def check(config: dict) -> list[str]:
    """What is wrong with the lengths of the lists."""
    out = []
    for a, b in (("mutpats", "mutrates"), ("selpats", "selcoef"), ("bases", "initfreqs")):
        if a in config and b in config and len(config[a]) != len(config[b]):
            out.append(f"{b} has {len(config[b])} values for {len(config[a])} {a}")
    for group in config.get("mutpats", []):
        out += [f"{a} and {b} differ in length" for a, b in group if len(a) != len(b)]
    return out


def dereferenced(config: dict, name: str) -> str:
    """The stanza that a name stands for."""
    for _ in range(MOST_HOPS):
        if not isinstance(config.get(name), str):
            return name
        name = config[name]
    raise ValueError(f"{name} is an alias that does not end")


def treeified(config: dict) -> dict:
    """A configuration without a tree is that of a stick with one tip."""
    if "tree" in config:
        tree = config["tree"]
        return config | {"tree": tree[0] if isinstance(tree, list) else tree}
    t = config.get("tlen", 1.0)
    return config | {"tree": f"(tip:{t[0] if isinstance(t, list) else t})root;", "tip": {k: config[k] for k in INHERITED if k in config}}


def models(config: dict) -> dict[str, dict]:
    """The stanza of each node below the root, with what it inherits."""
    config = treeified(config)
    edges = newick(config["tree"])
    out = {}
    for _, child, _ in edges:
        name = dereferenced(config, child)
        if not isinstance(config.get(name), dict):
            raise ValueError(f"no model for node {child}")
        out[child] = {k: config[k] for k in INHERITED if k in config} | config[name] | {"model": name}
    return out


def newick(text: str) -> list[tuple[str, str, float]]:
    """(parent, child, length) of each edge, parents before children."""
    tokens = re.findall(r"[(),;]|[^(),;]+", re.sub(r"\s", "", text))
    edges, stack, done, n = [], [[]], None, 0
    for t in tokens:
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            stack[-1].append([None, 0.0, done])
        elif t == ";":
            break
        elif t != ",":
            name, _, length = t.partition(":")
            if done is not None and stack[-1] and stack[-1][-1][0] is None:
                stack[-1][-1][:2] = [name, float(length or 0)]
            else:
                stack[-1].append([name, float(length or 0), []])
        if t == ",":
            done = None

    def walk(node):
        nonlocal n
        if not node[0]:
            n += 1
            node[0] = f"node{n}"
        for child in node[2]:
            if not child[0]:
                n += 1
                child[0] = f"node{n}"
            edges.append((node[0], child[0], child[1]))
            walk(child)

    walk(stack[0][0])
    return edges


def root(edges: list) -> str:
    return next(iter({p for p, _, _ in edges} - {c for _, c, _ in edges}))


def parent(edges: list, node: str) -> str | None:
    return next((p for p, c, _ in edges if c == node), None)


def renamed(edges: list, names: dict[str, str]) -> list:
    """The tree with other names of nodes; two nodes of one name are an error."""
    new = [(names.get(p, p), names.get(c, c), t) for p, c, t in edges]
    if len({c for _, c, _ in new} | {root(new)}) != len(new) + 1:
        raise ValueError("two nodes have one name")
    return new


def descendants(edges: list, node: str) -> list[str]:
    below = [c for p, c, _ in edges if p == node]
    return below + [x for c in below for x in descendants(edges, c)]


def cherries(edges: list) -> list[tuple[str, str, str]]:
    """(parent, tip, tip) of two tips with one parent."""
    parents = {p for p, _, _ in edges}
    tips: dict[str, list[str]] = {}
    for p, c, _ in edges:
        if c not in parents:
            tips.setdefault(p, []).append(c)
    return [(p, *t) for p, t in tips.items() if len(t) == 2]


def updated(config: dict, fits: dict[str, dict]) -> dict:
    """The configuration with fitted values: those of model k go to stanza k."""
    return config | {k: config[k] | v for k, v in fits.items() if isinstance(config.get(k), dict)} | {k: v for k, v in fits.items() if not isinstance(config.get(k), dict)}
