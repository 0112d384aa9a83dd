"""SQL text for the oracles: the same formulas, written out a second time for DuckDB.

Numbers are written in exponent form, which DuckDB reads as DOUBLE and not as DECIMAL.
"""

from __future__ import annotations

import numpy as np

PX = """px AS (
 SELECT l_suppkey AS video, l_linenumber AS frame, l_returnflag AS variant,
  CASE WHEN l_linestatus='O' THEN 'expert' ELSE 'synthetic' END AS track,
  l_quantity*CAST(20 AS DOUBLE) AS tr, l_discount*CAST(10000 AS DOUBLE) AS tg,
  l_tax*CAST(12500 AS DOUBLE) AS tb, l_quantity*CAST(16 AS DOUBLE)+5 AS pr,
  l_discount*CAST(8000 AS DOUBLE)+5 AS pg, l_tax*CAST(10000 AS DOUBLE)+5 AS pb
 FROM lineitem)"""
FRAMES = """frames AS (
 SELECT vec_id, vec_id // 10 AS video, vec_id % 10 AS frame, label,
  list_transform(embedding, lambda e: least(greatest(e::DOUBLE+5e-1,0e0),1e0)) AS plane FROM embeddings)"""
PLANES = """planes AS (
 SELECT vec_id // 10 AS video, vec_id % 10 AS frame, i % 8 AS x, i // 8 AS y,
  least(greatest(v::DOUBLE+5e-1,0e0),1e0) AS code
 FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"""
SIG = """sig AS (
 SELECT user_id AS video, event_id AS ordinal, ts, event_type AS variant,
  value*CAST(2 AS DOUBLE) AS nits,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"""
CORPUS = """corpus AS (
 SELECT doc_id, source AS source_dataset, lang AS category,
  substring(sha256(source||':'||doc_id::VARCHAR),1,32) AS video, n_chars AS bytes FROM documents)"""
TURNS = """turns AS (
 SELECT conv_id AS video, turn AS frame, role, text FROM conversations)"""
FEAT = """feat AS (
 SELECT vec_id, label, embedding[1:32]::DOUBLE[] AS s1, embedding[33:64]::DOUBLE[] AS s2
 FROM embeddings)"""


def d(value: float) -> str:
    return f"({float(value):.17e})"


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x},{d(low)}),{d(high)})"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x},{digits})"


m1, m2 = 2610 / 16384, 2523 / 4096 * 128
c1, c2, c3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32


def oetf(light: str) -> str:
    p = f"pow({clamp(light, 1e-10, 1)},{d(m1)})"
    return f"pow(({d(c1)}+{d(c2)}*{p})/(1e0+{d(c3)}*{p}),{d(m2)})"


def eotf(code: str) -> str:
    p = f"pow({clamp(code, 1e-8, 1)},{d(1 / m2)})"
    return f"pow(greatest({p}-{d(c1)},0e0)/({d(c2)}-{d(c3)}*{p}),{d(1 / m1)})"


def nits_code(nits: str) -> str:
    return oetf(f"(({nits})/1e4)")


def code_nits(code: str) -> str:
    return f"({eotf(code)}*1e4)"


def pq_number(nits: float) -> float:
    p = min(max(nits / 1e4, 1e-10), 1) ** m1
    return ((c1 + c2 * p) / (1 + c3 * p)) ** m2


def pu21(nits: str) -> str:
    p = f"pow({clamp(nits, 0.005, 1e4)},{d(0.9062562627)})"
    ratio = f"(({d(0.353487901)}+{d(0.3734658629)}*{p})/(1e0+{d(8.277049286e-05)}*{p}))"
    return f"greatest({d(596.3148142)}*(pow({ratio},{d(0.0915030316)})-{d(0.9099517204)}),0e0)"


PEAK = 596.3148142 * (
    ((0.353487901 + 0.3734658629 * 1e4**0.9062562627) / (1 + 8.277049286e-05 * 1e4**0.9062562627))
    ** 0.0915030316
    - 0.9099517204
)


def unpu21(units: str) -> str:
    ratio = f"pow(greatest({units},0e0)/{d(596.3148142)}+{d(0.9099517204)},{d(1 / 0.0915030316)})"
    p = f"greatest(({ratio}-{d(0.353487901)})/({d(0.3734658629)}-{d(8.277049286e-05)}*{ratio}),0e0)"
    return clamp(f"pow({p},{d(1 / 0.9062562627)})", 0.005, 1e4)


raw709 = np.array([[1.6605, -0.5876, -0.0728], [-0.1246, 1.1329, -0.0083], [-0.0182, -0.1006, 1.1187]])
M709 = raw709 / raw709.sum(axis=1, keepdims=True)
M2020 = np.linalg.inv(M709)
MP3 = np.array([[0.7530, 0.1986, 0.0484], [0.0457, 0.9418, 0.0125], [-0.0012, 0.0176, 0.9836]])
MXYZ = np.array([[0.6370, 0.1446, 0.1689], [0.2627, 0.6780, 0.0593], [0.0, 0.0281, 1.0610]])
MLMS = np.array([[1688, 2146, 262], [683, 2951, 462], [99, 309, 3688]]) / 4096
MITP = np.array([[2048, 2048, 0], [6610, -13613, 7003], [17933, -17390, -543]]) / 4096
Y2020 = (0.2627, 0.6780, 0.0593)
Y709 = (0.2126, 0.7152, 0.0722)


def dot(weights, colour) -> str:
    return "(" + "+".join(f"{d(w)}*({c})" for w, c in zip(weights, colour)) + ")"


def mat(matrix, colour) -> list[str]:
    return [dot(row, colour) for row in matrix]


def alias(colour, prefix: str, names: str = "rgb") -> str:
    return ", ".join(f"{c} AS {prefix}{n}" for c, n in zip(colour, names))


def bt1886(x: str) -> str:
    return f"pow({clamp(x, 0, 1)},2.4e0)"


def unbt1886(x: str) -> str:
    return f"pow({clamp(x, 0, 1)},{d(1 / 2.4)})"


CODED = "coded AS (SELECT video, frame, variant, track, " + ", ".join(
    f"{nits_code(s + c)} AS {s}{c}" for s in "tp" for c in "rgb"
) + " FROM px)"
LIT = "lit AS (SELECT video, frame, variant, track, " + ", ".join(
    f"{code_nits(s + c)} AS {s}{c}" for s in "tp" for c in "rgb"
) + " FROM coded)"


def rows(*parts: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select


def epoch(records: str, key: str, seed: int, number: int, batch: int) -> str:
    """``placed``: ``records`` with the batch and the place that the epoch gives them; ``key`` tells them apart."""

    def ticket(tag: str, value: str) -> str:
        return f"('0x'||substring(sha256('{tag}:'||{value}),1,12))::BIGINT"

    rounds = f"SELECT {key}, step, n, a, b, x % a AS l, x // a AS h FROM walk, sized WHERE step = 0 OR x >= n"
    for turn in range(4):
        moved = f"(l + {ticket(f'{seed}:{number}:{turn}', 'h')}) % {'b' if turn % 2 else 'a'}"
        rounds = f"SELECT {key}, step, n, a, b, h AS l, {moved} AS h FROM ({rounds})"
    return (
        f"sized AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM (SELECT count(*) AS n,"
        f" greatest(ceil(sqrt(count(*))), 1)::BIGINT AS a FROM {records})),"
        f" numbered AS (SELECT *, row_number() OVER (ORDER BY {ticket('ordinal', key)}, {key}) - 1 AS o FROM {records}),"
        f" walk({key}, step, x) AS (SELECT {key}, 0, o FROM numbered"
        f" UNION ALL SELECT {key}, step + 1, a * h + l FROM ({rounds})),"
        f" placed AS (SELECT r.*, x // {batch} AS batch_id, x % {batch} AS place FROM {records} r"
        f" JOIN walk USING ({key}), sized WHERE step > 0 AND x < n AND x // {batch} < n // {batch})"
    )
