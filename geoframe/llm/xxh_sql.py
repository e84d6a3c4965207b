"""XXH64 in DuckDB's SQL, for the oracle of operators that hash with it.

Numbers are UHUGEINT below 2^64; a product of two fits, and a remainder keeps the low half. The
hash is a fold over steps (v, k), where k tells what is done with v.
"""

from __future__ import annotations

# fixed values: the primes of the hash
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
P1, P2, P3, P4, P5 = (f"CAST({p} AS UHUGEINT)" for p in PRIMES)
WHOLE = "CAST(18446744073709551616 AS UHUGEINT)"


def _power(n: int) -> str:
    return f"CAST({2**n} AS UHUGEINT)"


def _xor(a: str, b: str) -> str:
    return f"CAST(xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT)) AS UHUGEINT)"


def _turn(x: str, n: int) -> str:
    """Rotation to the left."""
    return f"(({x} * {_power(n)}) % {WHOLE} + {x} // {_power(64 - n)})"


def _times(a: str, b: str) -> str:
    return f"(({a} * {b}) % {WHOLE})"


XOR, ADD, TIMES, TURN27, TURN23, TURN11, TURN31, FOLD33, FOLD29, FOLD32 = range(10)
STEP = f"""lambda p, q: {{'v': CASE q.k WHEN {XOR} THEN {_xor('p.v', 'q.v')} WHEN {ADD} THEN (p.v + q.v) % {WHOLE} WHEN {TIMES} THEN {_times('p.v', 'q.v')}
    WHEN {TURN27} THEN {_turn('p.v', 27)} WHEN {TURN23} THEN {_turn('p.v', 23)} WHEN {TURN11} THEN {_turn('p.v', 11)} WHEN {TURN31} THEN {_turn('p.v', 31)}
    WHEN {FOLD33} THEN {_xor('p.v', f'p.v // {_power(33)}')} WHEN {FOLD29} THEN {_xor('p.v', f'p.v // {_power(29)}')} ELSE {_xor('p.v', f'p.v // {_power(32)}')} END, 'k': 0}}"""


def _op(kind: int, value: str = "CAST(0 AS UHUGEINT)") -> str:
    return f"{{'v': {value}, 'k': {kind}}}"


def _fold(steps: str) -> str:
    return f"list_reduce({steps}, {STEP}).v"


def _round(lane: str) -> str:
    return _fold(f"[{_op(XOR, lane)}, {_op(TIMES, P2)}, {_op(TURN31)}, {_op(TIMES, P1)}]")


def _lane(start: str, size: int) -> str:
    """The number of ``size`` bytes, the low one first."""
    weights = ", ".join(_power(8 * k) for k in range(size))
    return f"list_reduce(list_transform(range(0, {size}), lambda j: bs[{start} + j + 1] * [{weights}][j + 1]), lambda u, w: u + w)"


def hashed(source: str, seed: int) -> str:
    """CTEs that end in ``hashed`` (x, h UBIGINT): the hash of the UTF-8 bytes of each distinct x of ``source``."""
    start = [(seed + PRIMES[0] + PRIMES[1]) % 2**64, (seed + PRIMES[1]) % 2**64, seed, (seed - PRIMES[0]) % 2**64]
    stripe = lambda k: f"list_concat([{_op(XOR, f'CAST({start[k]} AS UHUGEINT)')}], flatten(list_transform(range(0, stripes), lambda i: [{_op(ADD, _times(f'lanes[4 * i + {k + 1}]', P2))}, {_op(TURN31)}, {_op(TIMES, P1)}])))"
    four = ", ".join(f"CASE WHEN stripes > 0 THEN {_fold(stripe(k))} END AS v{k}" for k in range(4))
    rounds = ", ".join(f"CASE WHEN stripes > 0 THEN {_round(f'v{k}')} END AS r{k}" for k in range(4))
    merged = ", ".join(f"{_op(XOR, f'r{k}')}, {_op(TIMES, P1)}, {_op(ADD, P4)}" for k in range(4))
    turned = " + ".join(_turn(f"v{k}", n) for k, n in enumerate((1, 7, 12, 18)))
    steps = (
        f"list_concat([{_op(XOR, 'acc')}], CASE WHEN stripes > 0 THEN [{merged}] ELSE [] END, [{_op(ADD, 'CAST(n AS UHUGEINT)')}], "
        f"flatten(list_transform(tail, lambda t: [{_op(XOR, 't')}, {_op(TURN27)}, {_op(TIMES, P1)}, {_op(ADD, P4)}])), "
        f"CASE WHEN fours = 1 THEN [{_op(XOR, _times('four', P1))}, {_op(TURN23)}, {_op(TIMES, P2)}, {_op(ADD, P3)}] ELSE [] END, "
        f"flatten(list_transform(list_slice(bs, n // 4 * 4 + 1, n), lambda c: [{_op(XOR, _times('c', P5))}, {_op(TURN11)}, {_op(TIMES, P1)}])), "
        f"[{_op(FOLD33)}, {_op(TIMES, P2)}, {_op(FOLD29)}, {_op(TIMES, P3)}, {_op(FOLD32)}])"
    )
    return f"""hexes AS (SELECT x, hex(encode(x)) AS hx FROM (SELECT DISTINCT x FROM {source})),
bytes_ AS (SELECT x, list_transform(range(0, len(hx) // 2), lambda i: CAST((strpos('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hx[2 * i + 2]) - 1 AS UHUGEINT)) AS bs FROM hexes),
sizes AS (SELECT x, bs, len(bs) AS n, len(bs) // 32 AS stripes, len(bs) % 8 // 4 AS fours FROM bytes_),
lanes_ AS (SELECT *, list_transform(range(0, n // 8), lambda i: CAST({_lane('8 * i', 8)} AS UHUGEINT)) AS lanes, CASE WHEN fours = 1 THEN CAST({_lane('n // 8 * 8', 4)} AS UHUGEINT) END AS four FROM sizes),
stripes_ AS (SELECT *, {four} FROM lanes_),
tails AS (SELECT *, CASE WHEN stripes > 0 THEN ({turned}) % {WHOLE} ELSE CAST({(seed + PRIMES[4]) % 2**64} AS UHUGEINT) END AS acc, {rounds}, list_transform(list_slice(lanes, 4 * stripes + 1, len(lanes)), lambda lv: {_round('lv')}) AS tail FROM stripes_),
hashed AS (SELECT x, CAST({_fold(steps)} AS UBIGINT) AS h FROM tails)"""
