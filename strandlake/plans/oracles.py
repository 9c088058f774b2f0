"""DuckDB SQL of the catalogue, written independently of the operators."""

from __future__ import annotations

from strandlake.plans.fixtures import K, SQL, TABLES, M

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _code(x: str, n: int) -> str:
    """Two-bit code of n letters."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({x}, {i + 1}, 1)) - 1) * {4 ** (n - 1 - i)}" for i in range(n)) + ")::BIGINT"


def _canon(x: str) -> str:
    return f"least({x}, {_RC.format(x)})"


def minimizer(k: int, m: int) -> str:
    """The bin of ``kmer``."""
    mask = 0xE37E28C4271B5A2D & (4**m - 1)
    return "least(" + ", ".join(f"xor({_code(_canon(f'substr(kmer, {i + 1}, {m})'), m)}, {mask})" for i in range(k - m + 1)) + ")"


MINIMIZER = minimizer(K, M)


def windows_of(k: int) -> dict[str, str]:
    """k-mers of genomes and reads."""
    return {
        "gk": f"SELECT taxid, tier, ord, {_canon('km')} AS kmer FROM (SELECT taxid, tier, ord, substr(seq, i, {k}) AS km FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM genomes)) WHERE regexp_full_match(km, '[ACGT]+')",
        "rk": f"SELECT read_id, i - 1 AS pos, km AS kmer, {_canon('km')} AS canon, NOT regexp_full_match(km, '[ACGT]+') AS ambig FROM (SELECT read_id, i, substr(seq, i, {k}) AS km FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads))",
    }


CTE: dict[str, str] = {k: v.format(**{n: n for n in (*TABLES, *SQL)}) for k, v in SQL.items()}
CTE |= {
    "closure(taxid, ancestor, dist)": "SELECT taxid, taxid, 0::BIGINT FROM taxonomy UNION ALL SELECT c.taxid, t.parent, c.dist + 1 FROM closure c JOIN taxonomy t ON t.taxid = c.ancestor WHERE t.parent <> 0",
    "depths": "SELECT taxid, max(dist) AS depth FROM closure GROUP BY 1",
    "gk": windows_of(K)["gk"],
    "mem": "SELECT DISTINCT kmer, taxid FROM gk",
    "db": """SELECT s.kmer, arg_max(s.ancestor, d.depth) AS taxon FROM (SELECT m.kmer, c.ancestor, count(*) AS k FROM mem m JOIN closure c ON c.taxid = m.taxid GROUP BY 1, 2) s
        JOIN (SELECT kmer, count(*) AS n FROM mem GROUP BY 1) n ON n.kmer = s.kmer AND n.n = s.k JOIN depths d ON d.taxid = s.ancestor GROUP BY 1""",
    "rk": windows_of(K)["rk"],
    "hits": "SELECT read_id, pos, canon, ambig, coalesce(taxon, 0) AS taxon FROM rk LEFT JOIN db ON db.kmer = rk.canon AND NOT rk.ambig",
    "counts": "SELECT read_id, taxon, count(*) AS n FROM hits WHERE taxon <> 0 GROUP BY 1, 2",
    "scores": "SELECT a.read_id, a.taxon, sum(b.n)::BIGINT AS score FROM counts a JOIN closure c ON c.taxid = a.taxon JOIN counts b ON b.read_id = a.read_id AND b.taxon = c.ancestor GROUP BY 1, 2",
    "tied": "SELECT s.read_id, s.taxon, s.score FROM scores s JOIN (SELECT read_id, max(score) AS m FROM scores GROUP BY 1) b ON b.read_id = s.read_id AND b.m = s.score",
    "called": """SELECT s.read_id, arg_max(s.ancestor, d.depth) AS taxid, any_value(s.score) AS score FROM (SELECT t.read_id, c.ancestor, count(*) AS k, any_value(t.score) AS score FROM tied t JOIN closure c ON c.taxid = t.taxon GROUP BY 1, 2) s
        JOIN (SELECT read_id, count(*) AS n FROM tied GROUP BY 1) n ON n.read_id = s.read_id AND n.n = s.k JOIN depths d ON d.taxid = s.ancestor GROUP BY 1""",
    "calls": "SELECT r.read_id, coalesce(c.taxid, 0) AS taxid, coalesce(c.score, 0) AS score FROM reads r LEFT JOIN called c ON c.read_id = r.read_id",
    "runs": """SELECT read_id, run, any_value(code) AS code, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY read_id, code ORDER BY pos) AS run0, min(pos) OVER (PARTITION BY read_id, code, g) AS run
        FROM (SELECT read_id, pos, code, pos - row_number() OVER (PARTITION BY read_id, code ORDER BY pos) AS g FROM (SELECT read_id, pos, CASE WHEN ambig THEN 'A' ELSE taxon::VARCHAR END AS code FROM hits))) GROUP BY 1, 2""",
    "lists": "SELECT r.read_id, coalesce(h.t, '0:0') AS hitlist FROM reads r LEFT JOIN (SELECT read_id, string_agg(code || ':' || n::VARCHAR, ' ' ORDER BY run) AS t FROM runs GROUP BY 1) h ON h.read_id = r.read_id",
    "rc": "SELECT taxid, count(*) AS n_reads FROM calls GROUP BY 1",
    "kc": "SELECT taxon AS taxid, count(*) AS n_kmers, count(DISTINCT canon) AS n_unique FROM hits WHERE NOT ambig GROUP BY 1",
    "tc": "SELECT coalesce(rc.taxid, kc.taxid) AS taxid, coalesce(n_reads, 0) AS n_reads, coalesce(n_kmers, 0) AS n_kmers, coalesce(n_unique, 0) AS n_unique FROM rc FULL JOIN kc ON rc.taxid = kc.taxid",
    "clade": "SELECT u.up AS taxid, sum(n_reads)::BIGINT AS n_reads, sum(n_kmers)::BIGINT AS n_kmers, sum(n_unique)::BIGINT AS n_unique FROM tc JOIN (SELECT taxid, ancestor AS up FROM closure UNION ALL SELECT 0, 0) u ON u.taxid = tc.taxid GROUP BY 1",
    "sizes": "SELECT taxon AS taxid, count(*) AS n_kmers FROM db GROUP BY 1",
    "csizes": "SELECT c.ancestor AS taxid, sum(n_kmers)::BIGINT AS kmers_db FROM sizes JOIN closure c ON c.taxid = sizes.taxid GROUP BY 1",
}


def oracle(final: str, **extra: str) -> str:
    """The query with all that it needs in front."""
    ctes = CTE | extra
    wanted: list[str] = []

    def visit(sql: str) -> None:
        import re

        words = set(re.findall(r"\w+", sql))
        for k, body in ctes.items():
            if k.split("(")[0] in words and k not in wanted and body is not sql:
                wanted.append(k)
                visit(body)

    visit(final)
    ordered = sorted(wanted, key=list(ctes).index)
    return ("WITH RECURSIVE " + ", ".join(f"{k} AS ({ctes[k]})" for k in ordered) + " " if ordered else "") + final
