"""The grammar round by round, each over the whole sequence: slow, and what the engine's must equal."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

from lodequarry.operators.sequence import Grammar, Macro


def _equal_runs(nodes: list[tuple[str, int, int]], allowed: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    out, a = [], 0
    for b in range(1, len(nodes) + 1):
        if b == len(nodes) or nodes[b][0] != nodes[a][0]:
            if b - a >= 2 and allowed(nodes[a][1], nodes[b - 1][2]):
                out.append((a, b))
            a = b
    return out


def grammar(symbols: Sequence[str], cap: int = 50_000, most_rounds: int = 100_000, allowed: Callable[[int, int], bool] = lambda first, last: True) -> Grammar:
    """Fold a sequence: first runs of equal symbols, then again and again the most frequent pair of unlike neighbours and runs of the macros that arise.

    A round replaces one key everywhere. Runs are keyed by symbol and exact length, the largest saving first (ties: longer, more frequent, earlier, smaller
    symbol); pairs by frequency (ties: earlier, smaller); macro runs by symbol over all lengths, if they save more than one node. Pairs that touch share no node:
    the earlier one is replaced. `allowed` tells whether positions from first to last may become one node. Sequences of over `cap` nodes after the first
    folding are left there; `most_rounds` bounds the whole."""
    g = Grammar([(s, k, k) for k, s in enumerate(symbols)])
    fresh = 0
    rounds = 0

    def replace(spans: list[tuple[int, int]], name_of: Callable[[int], str], stage: str, said: str) -> None:
        out, at = [], 0
        for a, b in spans:
            out.extend(g.nodes[at:a])
            out.append((name_of(b - a), g.nodes[a][1], g.nodes[b - 1][2]))
            at = b
        out.extend(g.nodes[at:])
        g.nodes = out
        g.steps.append((stage, said, len(spans)))

    def run_macro(symbol: str, n: int, loop: bool) -> str:
        nonlocal fresh
        fresh += 1
        name = f"M{fresh}"
        g.macros[name] = Macro(name, "run", (symbol,), n, loop)
        return name

    while True:  # runs of the sequence itself
        rounds += 1
        if rounds > most_rounds:
            g.status = "round_limit_exceeded"
            return g
        by: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)
        for a, b in _equal_runs(g.nodes, allowed):
            by[g.nodes[a][0], b - a].append((a, b))
        if not by:
            break
        (symbol, n), spans = min(by.items(), key=lambda x: (-len(x[1]) * (x[0][1] - 1), -x[0][1], -len(x[1]), x[1][0][0], x[0][0]))
        name = run_macro(symbol, n, True)
        replace(spans, lambda _, name=name: name, "run_fold", name)
    if len(g.nodes) > cap:
        g.status = "sequence_too_large_for_full_pair_discovery"
        return g
    while True:
        rounds += 1
        if rounds > most_rounds:
            g.status = "round_limit_exceeded"
            return g
        count: Counter = Counter()
        first: dict[tuple[str, str], int] = {}
        for k in range(len(g.nodes) - 1):
            x, y = g.nodes[k], g.nodes[k + 1]
            if x[0] != y[0] and allowed(x[1], y[2]):
                count[x[0], y[0]] += 1
                first.setdefault((x[0], y[0]), k)
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], first[p], p))
        if count[pair] < 2:
            break
        fresh += 1
        name = f"M{fresh}"
        g.macros[name] = Macro(name, "pair", pair, 1, False)
        spans, k = [], 0
        while k < len(g.nodes) - 1:
            if (g.nodes[k][0], g.nodes[k + 1][0]) == pair and allowed(g.nodes[k][1], g.nodes[k + 1][2]):
                spans.append((k, k + 2))
                k += 1
            k += 1
        replace(spans, lambda _, name=name: name, "pair_grammar", name)
        while True:
            rounds += 1
            if rounds > most_rounds:
                g.status = "round_limit_exceeded"
                return g
            folds: dict[str, list[tuple[int, int]]] = defaultdict(list)
            for a, b in _equal_runs(g.nodes, allowed):
                m = g.macros.get(g.nodes[a][0])
                if m is not None and not m.is_loop:
                    folds[m.name].append((a, b))
            if not folds:
                break
            gain = lambda spans: sum(b - a - 1 for a, b in spans)
            symbol, spans = min(folds.items(), key=lambda x: (-gain(x[1]), -max(b - a for a, b in x[1]), -len(x[1]), x[1][0][0], x[0]))
            if gain(spans) <= 1:
                break
            names = {n: run_macro(symbol, n, True) for n in sorted({b - a for a, b in spans})}
            replace(spans, names.__getitem__, "macro_run_fold", "+".join(names.values()))
    return g
