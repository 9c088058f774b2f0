"""DNA, taxonomy and reads derived from the driver's tables; the SQL is the same for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.operators import database, tree

#: k-mer and minimizer lengths of the catalogue's queries.
K, M = 15, 7


def _dna(text: str) -> str:
    return f"translate(md5({text}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _str(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _genome(supplier: str, nation: str, region: str) -> str:
    keys = [f"'R:' || {_str(region)} || ':{i}'" for i in range(2)] + [f"'N:' || {_str(nation)} || ':{i}'" for i in range(4)] + [f"'S:' || {_str(supplier)} || ':{i}'" for i in range(4)] + ["'U:0'"]
    return " || ".join(_dna(k) for k in keys)


#: Name -> SQL over the driver's tables and earlier fixtures, in braces.
SQL = {
    "taxonomy": """SELECT CAST(1 AS BIGINT) AS taxid, CAST(0 AS BIGINT) AS parent, 'root' AS name, 'no rank' AS rank
        UNION ALL SELECT CAST(10 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), r_name, 'phylum' FROM {region}
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(10 + n_regionkey AS BIGINT), n_name, 'genus' FROM {nation}
        UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), s_name, 'species' FROM {supplier}""",
    "genomes": f"""SELECT 'G' || {_str('s_suppkey')} || '.1' AS seq_id, CAST(1000 + s_suppkey AS BIGINT) AS taxid, CAST(s_suppkey % 3 AS BIGINT) AS tier, CAST(s_suppkey AS BIGINT) AS ord,
        {_genome('s_suppkey', 's_nationkey', 'n_regionkey')} AS seq FROM {{supplier}} JOIN {{nation}} ON n_nationkey = s_nationkey""",
    "windows": """SELECT o_orderkey AS k, CAST(o_orderkey % 10 AS BIGINT) AS kind, taxid, substr(seq, CAST(1 + (o_orderkey * 7) % (length(seq) - 50) AS INT), 50) AS w
        FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM {supplier}) AS s FROM {orders}) o JOIN {genomes} g ON g.ord = o.s""",
    "reads": f"""SELECT k AS read_id, taxid AS true_taxid, CASE kind WHEN 0 THEN {_dna("'J:' || " + _str('k') + " || ':0'")} || left({_dna("'J:' || " + _str('k') + " || ':1'")}, 18)
        WHEN 1 THEN reverse(translate(w, 'ACGT', 'TGCA')) WHEN 2 THEN left(w, 20) || 'N' || substr(w, 22, 29) WHEN 3 THEN left(w, 10)
        WHEN 4 THEN left(w, 25) || left({_dna("'J:' || " + _str('k') + " || ':2'")}, 25) ELSE w END AS seq FROM {{windows}}""",
    "seqmap": f"""SELECT seq_id, taxid, 'strain ' || seq_id AS name, ord AS line_no FROM {{genomes}} WHERE ord % 4 <> 1
        UNION ALL SELECT left(seq_id, length(seq_id) - 2), taxid, 'strain ' || seq_id, 1000000 + ord FROM {{genomes}} WHERE ord % 4 = 1
        UNION ALL SELECT seq_id, CAST(1 AS BIGINT), 'late', 2000000 + ord FROM {{genomes}} WHERE ord % 4 <> 1""",
}
TABLES = ("region", "nation", "supplier", "orders")
_KEPT: dict[tuple, DataFrame] = {}
#: (folder, fixture) -> the same rows from a table, for measurements of what comes after.
PREPARED: dict[tuple[str, str], DataFrame] = {}


class Fixtures:
    """Lazy fixtures of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SQL:
            raise AttributeError(name)
        if (self.dir, name) in PREPARED:
            return PREPARED[self.dir, name]
        used = {n: self.table(n) if n in TABLES else getattr(self, n) for n in (*TABLES, *SQL) if "{" + n + "}" in SQL[name]}
        if "orders" in used:  # a small file is one split, but the reads made of it are work for all cores
            used["orders"] = used["orders"].repartition(self._parts())
        made = self.spark.sql(SQL[name], **used)
        # As are the genomes; dealt by the column that reads are joined on, so that these come in as many parts, however they join.
        return made.repartition(self._parts(), "ord") if name == "genomes" else made

    def _parts(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def _keep(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _KEPT:
            _KEPT[key] = make()
        return _KEPT[key]

    @property
    def tree(self) -> DataFrame:
        return self._keep("tree", lambda: tree.with_paths(self.taxonomy).persist())

    @property
    def genome_kmers(self) -> DataFrame:
        return database.genome_kmers(self.genomes, K)

    @property
    def kmer_table(self) -> DataFrame:
        return database.build_lca(self.genome_kmers, self.tree)
