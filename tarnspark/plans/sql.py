"""DuckDB SQL of the derived fixtures, from which the catalogue's oracles are put together."""

from __future__ import annotations

from tarnspark import schema as S

VECTORS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 10000 + 0.5)::BIGINT) AS vec FROM embeddings)"""


def dist(a: str, b: str, dims: int) -> str:
    return f"list_sum(list_transform(range(1, {dims + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))::BIGINT"


def top(k: int, source: str = "v", dims: int = 64, every: int = 100) -> str:
    """CTE n(id, rank, ref_id, dist): exact neighbours of the stated queries, themselves left out."""
    return f"""p AS (SELECT q.id AS id, r.id AS ref_id, {dist("q.vec", "r.vec", dims)} AS dist FROM {source} q JOIN {source} r ON q.id % {every} = 0 AND q.id <> r.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ref_id)::INT AS rank FROM p QUALIFY rank <= {k})"""


def cells(nlist: int, source: str = "v", dims: int = 64) -> str:
    """CTEs c(cell, vec), d(id, cell, dist, place): seed centroids and every row's distance to each, in order."""
    return f"""c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cell, vec FROM {source} QUALIFY row_number() OVER (ORDER BY id) <= {nlist}),
d0 AS (SELECT x.id, c.cell, {dist("x.vec", "c.vec", dims)} AS dist FROM {source} x, c),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cell) AS place FROM d0),
a AS (SELECT id, cell, dist FROM d WHERE place = 1)"""


def lloyd(steps: int, nlist: int, dims: int = 64) -> str:
    """CTEs a0 ... a<steps>(id, cell, dist): assignment to the seed centroids, and after each Lloyd step."""
    out = f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cell, vec FROM v QUALIFY row_number() OVER (ORDER BY id) <= {nlist})"
    for k in range(steps + 1):
        if k:
            out += f""",
m{k} AS (SELECT cell, i, floor(sum(v.vec[i])::DOUBLE / count(*)::DOUBLE + 0.5)::BIGINT AS x FROM a{k - 1} JOIN v USING (id), range(1, {dims + 1}) r(i) GROUP BY 1, 2),
l{k} AS (SELECT cell, list(x ORDER BY i) AS vec FROM m{k} GROUP BY 1),
c{k} AS (SELECT o.cell, coalesce(l{k}.vec, o.vec) AS vec FROM c{k - 1} o LEFT JOIN l{k} USING (cell))"""
        out += f""",
a{k} AS (SELECT x.id, c{k}.cell, {dist("x.vec", f"c{k}.vec", dims)} AS dist FROM v x, c{k} QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY dist, c{k}.cell) = 1)"""
    return out


def uniform(key: str, salt: str) -> str:
    """The engine's uniform draw."""
    return f"(('0x' || substr(md5('{salt}|' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def relaxed(epsilon: float, budget: int, nlist: int, dims: int, k: int = 5) -> str:
    """CTEs over v and cells(): s, what a relaxed search does with each cell; st(id, visits, checks, stopped); rc(id, n), positives among its
    neighbours. Bounds are those of the cells' boxes."""
    return f"""bw AS (SELECT cell, i, min(v.vec[i]) AS lo, max(v.vec[i]) AS hi FROM a JOIN v USING (id), range(1, {dims + 1}) r(i) GROUP BY 1, 2),
z AS (SELECT cell, count(*) AS n FROM a GROUP BY 1),
bb AS (SELECT v.id, bw.cell, sum(power(greatest(lo - v.vec[i], v.vec[i] - hi, 0), 2))::BIGINT AS bound FROM v, bw WHERE v.id % 100 = 0 GROUP BY 1, 2),
o AS (SELECT bb.id, bb.cell, bb.bound, z.n, coalesce(sum(z.n) OVER (PARTITION BY bb.id ORDER BY bb.bound, bb.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM bb JOIN z USING (cell)),
px AS (SELECT o.id, o.cell, o.ahead, a.id AS ref_id, {dist("x.vec", "y.vec", dims)} AS dist FROM o JOIN a ON a.cell = o.cell AND a.id <> o.id JOIN v x ON x.id = o.id JOIN v y ON y.id = a.id),
e1 AS (SELECT id, dist FROM px WHERE ahead < {k + 1} QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, ref_id) <= {k}),
e AS (SELECT id, CASE WHEN count(*) = {k} THEN max(dist) END AS kth FROM e1 GROUP BY 1),
s0 AS (SELECT o.*, coalesce(e.kth, 4611686018427387904)::DOUBLE AS kth FROM o LEFT JOIN e USING (id)),
s AS (SELECT id, cell, n, ahead < {k + 1} AS early, ahead >= {k + 1} AND bound <= kth AS matter, ahead >= {k + 1} AND bound <= kth * {1 - epsilon!r}::DOUBLE AND ahead < {budget} AS late FROM s0),
st AS (SELECT id, sum(CASE WHEN early OR late THEN n ELSE 0 END)::BIGINT AS visits, count(*)::BIGINT AS checks, bool_or(matter AND NOT late) AS stopped FROM s GROUP BY 1),
rt AS (SELECT px.id, px.ref_id FROM px JOIN s ON px.id = s.id AND px.cell = s.cell AND (s.early OR s.late) QUALIFY row_number() OVER (PARTITION BY px.id ORDER BY dist, ref_id) <= {k}),
rc AS (SELECT st.id, coalesce(y.p, 0)::INT AS n FROM st LEFT JOIN (SELECT rt.id, sum(v.is_fraud::INT) AS p FROM rt JOIN v ON v.id = rt.ref_id GROUP BY 1) y USING (id))"""


_CODES = ", ".join(f"'{m}'" for m in S.MCC_RISK)
_RISKS = " ".join(f"WHEN '{m}' THEN {r!r}::DOUBLE" for m, r in S.MCC_RISK.items())


def risk(mcc: str) -> str:
    return f"CASE {mcc} {_RISKS} ELSE {S.DEFAULT_RISK!r}::DOUBLE END"


def mcc_of(part: str) -> str:
    return f"[{_CODES}, '9999'][({part} % 11 + 1)::INT]"


def _r4(x: str) -> str:
    return f"(floor(({x}) * 10000::DOUBLE + 0.5::DOUBLE)::BIGINT * (1::DOUBLE / 10000))::FLOAT"


def _clamped(x: str, most: float) -> str:
    return _r4(f"least(1::DOUBLE, greatest(0::DOUBLE, ({x})::DOUBLE * (1::DOUBLE / {most!r}::DOUBLE)))")


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1::FLOAT ELSE 0::FLOAT END"


TRANSACTIONS = f"""li AS (SELECT l_orderkey, count(*)::INT AS installments, min(l_suppkey) AS supp, min(l_partkey) AS part FROM lineitem GROUP BY 1),
sl AS (SELECT l_suppkey, sum(floor(l_extendedprice))::BIGINT AS ss, count(*)::BIGINT AS sn FROM lineitem GROUP BY 1),
b0 AS (SELECT o_orderkey AS tx_id, o_custkey AS cust, o_orderstatus = 'F' AS is_fraud, floor(o_totalprice * 2)::BIGINT AS cents, installments,
              datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS dayno, (o_orderkey % 24)::INT AS hr, ((o_orderkey * 7) % 60)::INT AS mi,
              ((o_orderkey * 13) % 60)::INT AS sec, (isodow(o_orderdate) - 1)::INT AS wd, supp, {mcc_of("part")} AS mcc, ss::DOUBLE / sn::DOUBLE / 10::DOUBLE AS merchant_average,
              o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_online, s_nationkey AS nat, abs(s_nationkey - c_nationkey) AS steps
       FROM orders JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON supp = s_suppkey JOIN sl ON supp = l_suppkey),
b1 AS (SELECT *, dayno * 1440 + hr * 60 + mi AS m FROM b0),
b AS (SELECT *, sum(cents) OVER h AS past_cents, count(*) OVER h AS past_n,
             (count(*) OVER (PARTITION BY cust ORDER BY m RANGE BETWEEN 1440 PRECEDING AND CURRENT ROW) - 1)::INT AS tx24,
             lag(m) OVER (PARTITION BY cust ORDER BY m, tx_id) AS last_m, lag(sec) OVER (PARTITION BY cust ORDER BY m, tx_id) AS last_sec, lag(nat) OVER (PARTITION BY cust ORDER BY m, tx_id) AS last_nat,
             count(*) OVER (PARTITION BY cust, supp ORDER BY m, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM b1 WINDOW h AS (PARTITION BY cust ORDER BY m, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT tx_id, is_fraud, cents / 100::DOUBLE AS amount, installments, CASE WHEN past_n > 0 THEN past_cents::DOUBLE / 100::DOUBLE / past_n::DOUBLE ELSE 0::DOUBLE END AS customer_average,
             hr, wd, m, sec, last_m, last_sec, (abs(nat - last_nat) * 40)::DOUBLE AS last_km, (steps * 40)::DOUBLE AS km_from_home, tx24, is_online, NOT is_online AND tx_id % 10 <> 0 AS card_present,
             'MERC-' || supp AS merchant_id, seen = 0 AS unknown_merchant, mcc, merchant_average FROM b)"""

_FLOATS = [
    _clamped("amount", S.MAX_AMOUNT),
    _clamped("installments", S.MAX_INSTALLMENTS),
    _r4(f"least(1::DOUBLE, greatest(0::DOUBLE, CASE WHEN customer_average > 0 THEN (amount * (1::DOUBLE / {S.MAX_AMOUNT_RATIO!r}::DOUBLE)) / customer_average ELSE 0::DOUBLE END))"),
    _r4(f"hr::DOUBLE * (1::DOUBLE / {S.MAX_HOUR!r}::DOUBLE)"),
    _r4(f"wd::DOUBLE * (1::DOUBLE / {S.MAX_WEEKDAY!r}::DOUBLE)"),
    f"CASE WHEN last_m IS NULL THEN (-1)::FLOAT ELSE {_clamped('m - last_m', S.MAX_MINUTES)} END",
    f"CASE WHEN last_m IS NULL THEN (-1)::FLOAT ELSE {_clamped('last_km', S.MAX_KM)} END",
    _clamped("km_from_home", S.MAX_KM),
    _clamped("tx24", S.MAX_TX_COUNT),
    _flag("is_online"),
    _flag("card_present"),
    _flag("unknown_merchant"),
    _r4(risk("mcc")),
    _clamped("merchant_average", S.MAX_MERCHANT_AVERAGE),
]
FEATURES = f"""{TRANSACTIONS},
v AS (SELECT tx_id AS id, is_fraud, list_transform([{", ".join(_FLOATS)}], lambda x: floor(x::DOUBLE * 10000 + 0.5)::BIGINT) AS vec FROM t)"""
WIDE = ", ".join(f"vec[{k + 1}]::INT AS q{k}" for k in range(S.DIMS))


def counts(k: int = 5) -> str:
    """CTE f(id, fraud_count, fraud_score, approved) of the stated transaction queries."""
    return f"""{FEATURES}, {top(k, dims=S.DIMS)},
f AS (SELECT x.id, x.is_fraud, coalesce(y.s, 0)::INT AS fraud_count, coalesce(y.s, 0)::DOUBLE / 5::DOUBLE AS fraud_score, coalesce(y.s, 0)::DOUBLE / 5::DOUBLE < 0.6::DOUBLE AS approved
      FROM v x LEFT JOIN (SELECT n.id, sum(r.is_fraud::INT) AS s FROM n JOIN v r ON n.ref_id = r.id GROUP BY n.id) y ON x.id = y.id WHERE x.id % 100 = 0)"""


def number(x: str) -> str:
    """A double as JSON writes it."""
    return f"({x})::DOUBLE::VARCHAR"
