"""Distance, fit and geometry queries (embeddings as complexes of points)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from structscreen import constants as k
from structscreen.bindings.core import POINTS, Tables, query
from structscreen.functions import text as tx
from structscreen.functions import vec as v
from structscreen.operators import backbone as bb
from structscreen.operators import graph as gr
from structscreen.operators import lddt as ld
from structscreen.operators import learn as ln
from structscreen.operators import rigid as rg
from structscreen.operators import spatial as sp
from structscreen.operators import structure as st

BY = ["cid"]
XYZ = ("x", "y", "z")


def d_sql(a: str, b: str, pa="", pb="") -> str:
    return "sqrt(" + " + ".join(f"({a}.{pa}{c}-{b}.{pb}{c})*({a}.{pa}{c}-{b}.{pb}{c})" for c in XYZ) + ")"


LIG = POINTS + ", lig AS (SELECT cid, idx AS lig_idx, chain, lx AS x, ly AS y, lz AS z FROM pts)"
DAB = d_sql("a", "b")
MAB = d_sql("a", "b", "m", "m")


# --------------------------------------------------------------------- distance joins
@query("radius_join", f"WITH {LIG} SELECT a.cid, a.idx, b.lig_idx, round({DAB},6) AS distance FROM pts a JOIN lig b ON a.cid=b.cid WHERE {DAB} < 3")
def radius_join(t: Tables):
    out = sp.radius_join(t.points(), t.ligand(), 3.0, BY, a_cols=["idx"], b_cols=["lig_idx"])
    return out.select("cid", F.col("a_idx").alias("idx"), F.col("b_lig_idx").alias("lig_idx"), "distance")


@query("radius_graph_directed", f"WITH {POINTS} SELECT a.cid, a.idx AS i, b.idx AS j, round({DAB},6) AS distance FROM pts a JOIN pts b ON a.cid=b.cid AND a.idx<>b.idx WHERE {DAB} < 2.5")
def radius_graph_directed(t: Tables):
    g = sp.radius_graph(t.points(), 2.5, BY, id_col="idx")
    return g.select("cid", F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), "distance")


@query("radius_pairs_per_supplier", """WITH p AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity AS x, l_extendedprice/2000 AS y, l_discount*400 AS z FROM lineitem)
SELECT a.l_suppkey, count(*) AS n_pairs FROM p a JOIN p b ON a.l_suppkey=b.l_suppkey AND (a.l_orderkey,a.l_partkey,a.l_linenumber) < (b.l_orderkey,b.l_partkey,b.l_linenumber)
WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 9 GROUP BY 1""")
def radius_pairs_per_supplier(t: Tables):
    # some hundred points in a box of 50 x 52 x 40
    return sp.radius_pairs(_supplier_points(t), 3.0, ["l_suppkey"], id_col="id", side=4.0).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_pairs"))


def _supplier_points(t: Tables):
    c = F.col
    # the test table is one row group, and every row makes fourteen
    return t.dealt(t.lineitem, "l_orderkey").select(
        "l_suppkey", F.struct("l_orderkey", "l_partkey", "l_linenumber").alias("id"), c("l_quantity").alias("x"),
        (c("l_extendedprice") / 2000).alias("y"), (c("l_discount") * 400).alias("z"),
    )


@query("scaled_radius_join", f"""WITH {LIG}, r AS (SELECT cid, 2.0 + cid % 3 AS cutoff FROM (SELECT DISTINCT cid FROM pts))
SELECT a.cid, a.idx, b.lig_idx FROM pts a JOIN lig b ON a.cid=b.cid JOIN r ON r.cid=a.cid WHERE {DAB}/cutoff <= 1""")
def scaled_radius_join(t: Tables):
    cut = (F.lit(2.0) + F.col("cid") % 3).alias("cutoff")
    out = sp.radius_join(t.points().select("*", cut), t.ligand().select("*", cut), "cutoff", BY, a_cols=["idx"], b_cols=["lig_idx"])
    return out.select("cid", F.col("a_idx").alias("idx"), F.col("b_lig_idx").alias("lig_idx"))


@query("neighbor_graph_capped", f"""WITH {POINTS}, e AS (SELECT a.cid, a.idx AS i, b.idx AS j, {DAB} AS d FROM pts a JOIN pts b ON a.cid=b.cid AND a.idx<>b.idx WHERE {DAB} < 8)
SELECT cid, i, j, round(d,6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cid, i ORDER BY d, j) AS rn FROM e) WHERE rn <= 10""")
def neighbor_graph_capped(t: Tables):
    g = sp.neighbor_graph(t.points(), 8.0, 10, BY, id_col="idx", on_isolated="keep")
    return g.select("cid", F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), "distance")


@query("nearest_neighbors", f"""WITH {POINTS}, e AS (SELECT a.cid, a.idx AS i, b.idx AS j, {DAB} AS d FROM pts a JOIN pts b ON a.cid=b.cid AND a.idx<>b.idx)
SELECT cid, i, j, round(d,6) AS distance, rn::INTEGER AS neighbor_rank FROM (SELECT *, row_number() OVER (PARTITION BY cid, i ORDER BY d, j) AS rn FROM e) WHERE rn <= 4""")
def nearest_neighbors(t: Tables):
    g = sp.knn_join(t.points(), t.points(), 4, BY, q_id="idx", p_id="idx", exclude_same_id=True)
    return g.select("cid", F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), "distance", "neighbor_rank")


@query("tiered_neighbors", f"""WITH {POINTS}, q AS (SELECT cid, idx % 50 + 3 * ((idx % 50) // 7) AS pos, CASE WHEN idx % 7 <> 3 THEN x END AS x, y, z FROM pts),
e AS (SELECT a.cid, a.pos AS i, b.pos AS j, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+1e-8)
  ELSE 1e8+abs(a.pos-b.pos)*1e6 END AS d FROM q a JOIN q b ON a.cid=b.cid)
SELECT cid, i, j, round(d,6) AS adjusted, d < 5e7 AS has_coordinates FROM (SELECT *, row_number() OVER (PARTITION BY cid, i ORDER BY d, j) AS rn FROM e) WHERE rn <= 6""")
def tiered_neighbors(t: Tables):
    i = F.col("idx") % 50  # positions with gaps
    p = t.points().select("cid", (i + 3 * F.floor(i / 7)).alias("pos"), F.when(F.col("idx") % 7 != 3, F.col("x")).alias("x"), "y", "z")
    return sp.knn_tiered(p, 6, BY).select("cid", "i", "j", "adjusted", "has_coordinates")


@query("nearest_chain", f"""WITH {LIG} SELECT cid, lig_idx, chain, round(d,6) AS distance FROM (SELECT b.cid, b.lig_idx, a.chain, {DAB} AS d,
  row_number() OVER (PARTITION BY b.cid, b.lig_idx ORDER BY {DAB}, a.idx) AS rn FROM pts a JOIN lig b ON a.cid=b.cid) WHERE rn = 1""")
def nearest_chain(t: Tables):
    return sp.nearest_chain(t.points(), t.ligand().drop("chain"), BY, point_id="lig_idx")


RESIDUES = f"""WITH {LIG}, a AS (SELECT *, idx // 5 AS resid, CASE idx % 5 WHEN 1 THEN 'CA' WHEN 4 THEN CASE WHEN (idx // 5) % 3 = 1 THEN 'O' ELSE 'CB' END WHEN 2 THEN CASE WHEN (idx // 5) % 7 = 2 THEN 'CB' ELSE 'C' END ELSE 'N' END AS name FROM pts),
rs AS (SELECT cid, resid, x, y, z, min(idx) OVER (PARTITION BY cid, resid) AS first_line, row_number() OVER (PARTITION BY cid, resid ORDER BY (name <> 'CB')::INT, idx) AS nth FROM a WHERE name IN ('CA', 'CB'))"""


def _residues(t: Tables):
    r, i = F.floor(F.col("idx") / 5), F.col("idx") % 5
    name = F.when(i == 1, "CA").when((i == 4) & (r % 3 != 1), "CB").when((i == 2) & (r % 7 == 2), "CB").otherwise("N")
    atoms = t.points().select("cid", r.alias("resid"), name.alias("atom_name"), F.col("idx").alias("line_idx"), *XYZ)
    return sp.representative_points(atoms, ["cid", "resid"])


@query("representative_points", f"{RESIDUES} SELECT cid, resid, first_line, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM rs WHERE nth = 1")
def representative_points(t: Tables):
    return _residues(t)


@query("nearest_residue", f"""{RESIDUES} SELECT cid, lig_idx, resid, round(d,6) AS distance FROM (SELECT b.cid, b.lig_idx, a.resid, {DAB} AS d,
  row_number() OVER (PARTITION BY b.cid, b.lig_idx ORDER BY {DAB}, a.first_line) AS rn FROM rs a JOIN lig b ON a.cid=b.cid WHERE a.nth = 1) WHERE rn = 1""")
def nearest_residue(t: Tables):
    points = _residues(t).withColumnRenamed("first_line", "idx")
    return sp.nearest_chain(points, t.ligand().drop("chain"), BY, chain="resid", point_id="lig_idx")


@query("pocket_atoms_near_ligand", f"WITH {LIG} SELECT a.cid, a.idx FROM pts a WHERE EXISTS (SELECT 1 FROM lig b WHERE a.cid=b.cid AND {DAB} < 2)")
def pocket_atoms_near_ligand(t: Tables):
    return sp.pocket_atoms(t.points(), t.ligand(), 2.0, BY).select("cid", "idx")


@query("pocket_around_centroid", f"WITH {LIG}, b AS (SELECT cid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lig GROUP BY 1) SELECT a.cid, a.idx FROM pts a JOIN b ON a.cid=b.cid WHERE {DAB} < 4")
def pocket_around_centroid(t: Tables):
    return sp.pocket_atoms(t.points(), t.ligand(), 4.0, BY, around="centroid").select("cid", "idx")


@query("extract_pockets", f"""WITH {LIG}, c AS (SELECT cid, x, y, z, row_number() OVER (PARTITION BY cid ORDER BY lig_idx) AS pocket_rank FROM lig)
SELECT a.cid, a.idx, pocket_rank::INTEGER AS pocket_rank FROM pts a JOIN c b ON a.cid=b.cid WHERE pocket_rank <= 2 AND chain < 5 AND idx % 11 <> 4 AND {DAB} < 4""")
def extract_pockets(t: Tables):
    # a residue is one point; chains A and B repeat each other's numbers, every 11th row is no ATOM
    number = F.row_number().over(Window.partitionBy("cid", F.col("chain") < 5).orderBy("idx"))
    pts = t.points().withColumns({"resid": number, "record": F.when(F.col("idx") % 11 == 4, "HETATM").otherwise("ATOM")}).withColumn("chain", F.when(F.col("chain") < 5, "A").otherwise("B"))
    lig = t.ligand().withColumn("pocket_rank", (F.col("lig_idx") % 50).cast("int") + 1)
    centres = lig.select("cid", "pocket_rank", *[F.col(c).alias(f"center_{c}") for c in XYZ])
    return sp.extract_pockets(pts, pts, centres, 4.0, 2, by=BY).select("cid", "idx", "pocket_rank")


# --------------------------------------------------------------------- clash, lDDT
ELEMENT = "CASE idx % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'O' WHEN 3 THEN 'H' ELSE 'CL' END"
RADIUS = "CASE {} WHEN 'C' THEN 1.7 WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 WHEN 'Cl' THEN 1.75 ELSE 2.0 END"
SYMBOL = "CASE lig_idx % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'Cl' ELSE 'Zn' END"


def _element(col):
    r = F.col(col) % 5
    return F.when(r == 0, "C").when(r == 1, "N").when(r == 2, "O").when(r == 3, "H").otherwise("CL")


@query("clash_score", f"""WITH {LIG}, p AS (SELECT *, {ELEMENT} AS element FROM pts), q AS (SELECT *, {SYMBOL} AS symbol FROM lig),
e AS (SELECT a.cid, {RADIUS.format('element')} + {RADIUS.format('symbol')} - {DAB} AS o FROM p a JOIN q b ON a.cid=b.cid WHERE element <> 'H' AND {DAB} < 4),
s AS (SELECT cid, sqrt(coalesce(sum(CASE WHEN o>0 THEN o*o END),0)/(1e-8+count(*))) AS clashScore, coalesce(avg(CASE WHEN o>0 THEN o END),0) AS overlap_mean,
  count(CASE WHEN o>0 THEN 1 END) AS clash_n, count(*) AS n FROM e GROUP BY 1)
SELECT g.cid, round(coalesce(clashScore,0),6) AS clashScore, round(coalesce(overlap_mean,0),6) AS overlap_mean, coalesce(clash_n,0) AS clash_n, coalesce(n,0) AS n
FROM (SELECT DISTINCT cid FROM pts) g LEFT JOIN s ON g.cid=s.cid""")
def clash_score(t: Tables):
    r = F.col("lig_idx") % 3
    lig = t.ligand().withColumn("symbol", F.when(r == 0, "C").when(r == 1, "Cl").otherwise("Zn"))
    return st.clash_score(t.points().withColumn("element", _element("idx")), lig, BY)


def _lddt_names(idx):
    """Residue, residue name and atom name of ten-atom residues, every third of them with symmetric atoms."""
    pos = idx % 10
    name = F.when(pos == 2, "CD1").when(pos == 3, "CE1").when(pos == 7, "CD2").when(pos == 8, "CE2").otherwise(F.concat(F.lit("X"), pos))
    res = F.floor(idx / 10)
    return res.alias("res_idx"), F.when(res % 3 == 0, "PHE").otherwise("ALA").alias("resname"), name.alias("atom_name")


def _lddt_atoms(t: Tables):
    """Atoms of one model per complex, their symmetry by residue and atom names."""
    named = t.points().select("*", *_lddt_names(F.col("idx")))
    return named.select(
        "cid", F.col("idx").alias("atom_idx"), "res_idx", st.symmetry_class(F.col("resname"), F.col("atom_name")).alias("amb"),
        *[F.col(c).alias("r" + c) for c in XYZ], *["m" + c for c in XYZ],
    )


LDDT = LIG + f""", atm AS (SELECT *, idx // 10 AS res, CASE WHEN (idx//10)%3<>0 THEN 0 WHEN idx%10 IN (2,3) THEN 1 WHEN idx%10 IN (7,8) THEN 2 ELSE 0 END AS amb FROM pts),
sw AS (SELECT a.*, coalesce(b.mx,a.mx) AS sx, coalesce(b.my,a.my) AS sy, coalesce(b.mz,a.mz) AS sz FROM atm a LEFT JOIN atm b ON a.amb>0 AND b.idx = CASE WHEN a.amb=1 THEN a.idx+5 ELSE a.idx-5 END),
cnt AS (SELECT a.cid, a.res, sum((abs({MAB}-{DAB})<=0.5)::INT+(abs({MAB}-{DAB})<=1)::INT+(abs({MAB}-{DAB})<=2)::INT+(abs({MAB}-{DAB})<=4)::INT) AS p,
  sum((abs({d_sql('a','b','s','m')}-{DAB})<=0.5)::INT+(abs({d_sql('a','b','s','m')}-{DAB})<=1)::INT+(abs({d_sql('a','b','s','m')}-{DAB})<=2)::INT+(abs({d_sql('a','b','s','m')}-{DAB})<=4)::INT) AS s
  FROM sw a JOIN sw b ON a.cid=b.cid AND a.res<>b.res AND b.amb=0 WHERE {DAB} < 6 AND a.res % 3 = 0 GROUP BY 1,2),
ch AS (SELECT w.cid, w.idx, w.res, w.x, w.y, w.z, CASE WHEN s>p THEN sx ELSE mx END AS mx, CASE WHEN s>p THEN sy ELSE my END AS my, CASE WHEN s>p THEN sz ELSE mz END AS mz
  FROM sw w LEFT JOIN cnt USING (cid, res)),
st AS (SELECT *, EXISTS (SELECT 1 FROM lig b WHERE b.cid=a.cid AND {d_sql('a','b','m','')} < 2) AS site FROM ch a),
pr AS (SELECT a.cid, a.res AS ra, b.res AS rb, a.site AND b.site AS site, (abs({MAB}-{DAB})<=0.5)::INT+(abs({MAB}-{DAB})<=1)::INT+(abs({MAB}-{DAB})<=2)::INT+(abs({MAB}-{DAB})<=4)::INT AS kept
  FROM st a JOIN st b ON a.cid=b.cid AND a.idx<b.idx AND a.res<>b.res WHERE {DAB} < 6)"""


@query("lddt_with_binding_site", f"""WITH {LDDT} SELECT cid, sum(kept)::BIGINT AS conserved_distances, count(*)*4 AS total_n_distances, coalesce(sum(CASE WHEN site THEN kept END),0)::BIGINT AS bs_conserved,
  count(CASE WHEN site THEN 1 END)*4 AS bs_total, round(sum(kept)/(count(*)*4.0),6) AS lddt, round(coalesce(sum(CASE WHEN site THEN kept END),0)/(1e-5+count(CASE WHEN site THEN 1 END)*4),6) AS bs_lddt FROM pr GROUP BY 1""")
def lddt_with_binding_site(t: Tables):
    return ld.lddt(_lddt_atoms(t), BY, radius=6.0, ligand=t.ligand(), cutoff=2.0)


@query("lddt_per_residue", f"""WITH {LDDT}, e AS (SELECT cid, ra AS res_idx, kept FROM pr UNION ALL SELECT cid, rb, kept FROM pr)
SELECT cid, res_idx, sum(kept)::BIGINT AS conserved, count(*)*4 AS total, round(sum(kept)/(count(*)*4.0),6) AS score FROM e GROUP BY 1,2""")
def lddt_per_residue(t: Tables):
    return ld.lddt_per_residue(_lddt_atoms(t), BY, radius=6.0)


@query("lddt_symmetry_choice", f"WITH {LDDT} SELECT cid, idx AS atom_idx, round(mx,6) AS mx, round(my,6) AS my, round(mz,6) AS mz FROM ch")
def lddt_symmetry_choice(t: Tables):
    return ld.resolve_symmetry(_lddt_atoms(t), BY, radius=6.0).select("cid", "atom_idx", "mx", "my", "mz")


KEPT_MM = f"(abs({MAB}-{DAB})<=0.5)::INT+(abs({MAB}-{DAB})<=1)::INT+(abs({MAB}-{DAB})<=2)::INT+(abs({MAB}-{DAB})<=4)::INT"
KEPT_SM = KEPT_MM.replace(MAB, d_sql("a", "b", "s", "m"))


@query("lddt_of_poses", f"""WITH {LIG}, m AS (SELECT cid, pose, idx, idx//10 AS res, x, y, z, mx+pose*lx*0.1 AS mx, my+pose*ly*0.1 AS my, mz+pose*lz*0.1 AS mz,
  CASE WHEN (idx//10)%3<>0 THEN 0 WHEN idx%10 IN (2,3) THEN 1 WHEN idx%10 IN (7,8) THEN 2 ELSE 0 END AS amb FROM pts, (VALUES (0),(1),(2)) s(pose) WHERE idx%50<45 AND (idx+pose)%17<>0),
r AS (SELECT *, count(CASE WHEN amb=1 THEN 1 END) OVER (PARTITION BY cid, pose, res) AS n1, count(CASE WHEN amb=2 THEN 1 END) OVER (PARTITION BY cid, pose, res) AS n2,
  row_number() OVER (PARTITION BY cid, pose, res, amb ORDER BY idx) AS nth FROM m),
sw AS (SELECT a.*, coalesce(b.mx,a.mx) AS sx, coalesce(b.my,a.my) AS sy, coalesce(b.mz,a.mz) AS sz FROM r a
  LEFT JOIN r b ON a.cid=b.cid AND a.pose=b.pose AND a.res=b.res AND a.amb>0 AND a.n1=a.n2 AND b.amb=3-a.amb AND b.nth=a.nth),
cnt AS (SELECT a.cid, a.pose, a.res, sum({KEPT_MM}) AS p, sum({KEPT_SM}) AS s FROM sw a JOIN sw b ON a.cid=b.cid AND a.pose=b.pose AND a.res<>b.res AND b.amb=0
  WHERE {DAB} < 6 AND a.amb>0 AND a.n1=a.n2 GROUP BY 1,2,3),
ch AS (SELECT w.cid, w.pose, w.idx, w.res, w.x, w.y, w.z, CASE WHEN s>p THEN sx ELSE mx END AS mx, CASE WHEN s>p THEN sy ELSE my END AS my, CASE WHEN s>p THEN sz ELSE mz END AS mz
  FROM sw w LEFT JOIN cnt USING (cid, pose, res)),
st AS (SELECT *, EXISTS (SELECT 1 FROM lig b WHERE b.cid=a.cid AND b.lig_idx%3=a.pose AND {d_sql('a','b','m','')} < 2.5) AS site FROM ch a),
pr AS (SELECT a.cid, a.pose, a.site AND b.site AS site, {KEPT_MM} AS kept FROM st a JOIN st b ON a.cid=b.cid AND a.pose=b.pose AND a.idx<b.idx AND a.res<>b.res WHERE {DAB} < 6)
SELECT cid, pose::INTEGER AS pose, sum(kept)::BIGINT AS conserved_distances, count(*)*4 AS total_n_distances, coalesce(sum(CASE WHEN site THEN kept END),0)::BIGINT AS bs_conserved,
  count(CASE WHEN site THEN 1 END)*4 AS bs_total, round(sum(kept)/(count(*)*4.0),6) AS lddt, round(coalesce(sum(CASE WHEN site THEN kept END),0)/(1e-5+count(CASE WHEN site THEN 1 END)*4),6) AS bs_lddt
FROM pr GROUP BY 1, 2""")
def lddt_of_poses(t: Tables):
    # two atom tables of two chains each; every pose lacks some atoms and has a ligand of its own
    chain = F.when(F.col("idx") % 50 < 45, "A").otherwise("B").alias("chain")
    named = t.points().select("cid", "idx", chain, *_lddt_names(F.col("idx")), *XYZ, *["m" + c for c in XYZ], *["l" + c for c in XYZ])
    posed = named.withColumn("pose", F.explode(F.array(*[F.lit(p) for p in range(3)]))).where((F.col("idx") + F.col("pose")) % 17 != 0)
    model = posed.select("cid", "pose", "idx", "chain", "res_idx", "atom_name", *[(F.col("m" + c) + F.col("pose") * F.col("l" + c) * 0.1).alias(c) for c in XYZ])
    names = {"residue": "res_idx", "order": "idx"}
    atoms = ld.lddt_input(named.select("cid", "idx", "chain", "res_idx", "resname", "atom_name", *XYZ), model, BY, ["pose"], **names)
    ligand = t.ligand().withColumn("pose", (F.col("lig_idx") % 3).cast("int"))
    return ld.lddt_of_models(atoms, BY, ["pose"], radius=6.0, ligand=ligand, cutoff=2.5)


@query("cross_lddt", f"""WITH {POINTS}, q AS (SELECT cid, idx, lx AS x, ly AS y, lz AS z, lx+mx-x AS mx, ly+mx-x AS my, lz AS mz FROM pts)
SELECT a.cid, round(sum(((abs({MAB}-{DAB})<0.5)::INT+(abs({MAB}-{DAB})<1)::INT+(abs({MAB}-{DAB})<2)::INT+(abs({MAB}-{DAB})<4)::INT)*0.25)/(count(*)+1e-12),6) AS cross_lddt, count(*) AS n_pairs
FROM pts a JOIN q b ON a.cid=b.cid WHERE {DAB} < 6 GROUP BY 1""")
def cross_lddt(t: Tables):
    q = t.points().select(
        "cid", F.col("lx").alias("x"), F.col("ly").alias("y"), F.col("lz").alias("z"), (F.col("lx") + F.col("mx") - F.col("x")).alias("mx"),
        (F.col("ly") + F.col("mx") - F.col("x")).alias("my"), F.col("lz").alias("mz"),
    )
    return st.cross_lddt(t.points(), q, BY, radius=6.0)


@query("bond_violations", f"WITH {POINTS} SELECT a.cid, count(CASE WHEN abs({MAB}-{DAB}) > 0.1 THEN 1 END) AS violations, count(*) AS bonds FROM pts a JOIN pts b ON a.cid=b.cid AND a.idx<b.idx WHERE {DAB} < 2 GROUP BY 1")
def bond_violations(t: Tables):
    return st.bond_violations(t.points(), BY, index="idx", limit=0.1)


@query("bond_violations_by_table", f"WITH {POINTS} SELECT a.cid, 2*count(CASE WHEN abs({MAB}-{DAB}) > 0.1 THEN 1 END) AS violations, 2*count(*) AS bonds FROM pts a JOIN pts b ON a.cid=b.cid AND b.idx=a.idx+1 GROUP BY 1")
def bond_violations_by_table(t: Tables):
    bonds = t.points().where("idx % 50 < 49").select("cid", F.col("idx").alias("a"), (F.col("idx") + 1).alias("b"))
    return st.bond_violations(t.points(), BY, index="idx", limit=0.1, bonds=bonds, directed=True)


NAMES = ("N", "CA", "C", "O", "CB")
NAME_SQL = "CASE idx % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' WHEN 3 THEN 'O' ELSE 'CB' END"
IDEAL_SQL = "CASE a.idx % 5 WHEN 0 THEN 1.4664 WHEN 1 THEN 1.5335 WHEN 2 THEN 1.23 END"


def _name(col="idx"):
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col(col) % 5 + 1).cast("int"))


@query("ideal_bond_violations", f"""WITH {POINTS} SELECT a.cid, count(CASE WHEN abs({IDEAL_SQL}-{DAB}) > 1.5 THEN 1 END) AS violations FROM pts a JOIN pts b ON a.cid=b.cid AND b.idx=a.idx+1 WHERE a.idx % 5 < 3 GROUP BY 1""")
def ideal_bond_violations(t: Tables):
    atoms = t.points().withColumns({"atom_name": _name(), "resid": F.floor(F.col("idx") / 5)})
    bonds = t.points().where("idx % 5 < 3").select("cid", F.col("idx").alias("a"), (F.col("idx") + 1).alias("b"))
    return st.ideal_bond_violations(atoms, bonds, BY, index="idx", limit=1.5).select("cid", "violations")


@query("neighbor_anisotropy", f"""WITH {POINTS}, e AS (SELECT a.cid, a.idx, {DAB} AS d, a.x-b.x AS dx, a.y-b.y AS dy, a.z-b.z AS dz FROM pts a JOIN pts b ON a.cid=b.cid AND a.idx<>b.idx WHERE {DAB} < 4),
s AS (SELECT cid, idx, sigma, exp(-d*d/sigma) AS w, d, dx, dy, dz FROM e, (SELECT unnest([1.0,2.0,5.0,10.0,30.0]) AS sigma))
SELECT cid, idx, sigma, round(sqrt(pow(sum(w*dx),2)+pow(sum(w*dy),2)+pow(sum(w*dz),2))/sum(w*d),6) AS mu_r_norm FROM s GROUP BY 1,2,3""")
def neighbor_anisotropy(t: Tables):
    out = st.mu_r_norm(sp.radius_graph(t.points(), 4.0, BY, id_col="idx"), BY)
    return out.withColumnRenamed("a_idx", "idx")


@query("scatter_edges_to_nodes", f"WITH {POINTS} SELECT a.cid, a.idx AS a_idx, round(avg({DAB}),6) AS distance FROM pts a JOIN pts b ON a.cid=b.cid AND a.idx<>b.idx WHERE {DAB} < 3 GROUP BY 1,2")
def scatter_edges_to_nodes(t: Tables):
    return st.scatter(sp.radius_graph(t.points(), 3.0, BY, id_col="idx"), ["cid", "a_idx"], "distance")


@query("atom_contact_graph", f"""WITH {POINTS}, atm AS (SELECT *, idx // 10 AS res FROM pts), ca AS (SELECT * FROM atm WHERE idx % 5 = 1)
SELECT a.cid, a.idx AS ca_idx, b.idx AS atom_idx FROM ca a JOIN atm b ON a.cid=b.cid AND a.res<>b.res WHERE {DAB} < 3""")
def atom_contact_graph(t: Tables):
    at = t.points().withColumn("res", F.floor(F.col("idx") / 10))
    out = sp.radius_join(at, at.where("idx % 5 = 1"), 3.0, BY, a_cols=["idx", "res"], b_cols=["idx", "res"])
    return out.where("a_res <> b_res").select("cid", F.col("b_idx").alias("ca_idx"), F.col("a_idx").alias("atom_idx"))


# --------------------------------------------------------------------- fits and centres
def _pairs(t: Tables):
    return t.points().select("cid", F.col("idx").alias("atom_idx"), *[F.col(c).alias("a_" + c) for c in XYZ], *[F.col("m" + c).alias("b_" + c) for c in XYZ])


MOVE = "(mx-x)*(mx-x)+(my-y)*(my-y)+(mz-z)*(mz-z)"


@query("coordinate_rmsd", f"WITH {POINTS} SELECT cid, round(sqrt(avg({MOVE})),6) AS rmsd FROM pts GROUP BY 1")
def coordinate_rmsd(t: Tables):
    return rg.rmsd(_pairs(t), BY)


@query("protein_and_pocket_rmsd", f"""WITH {LIG}, f AS (SELECT *, EXISTS (SELECT 1 FROM lig b WHERE a.cid=b.cid AND {DAB} < 1) AS near FROM pts a)
SELECT cid, round(sqrt(avg({MOVE})),6) AS protein_rmsd, round(coalesce(sqrt(avg(CASE WHEN near THEN {MOVE} END)),-1),6) AS pocket_rmsd FROM f GROUP BY 1""")
def protein_and_pocket_rmsd(t: Tables):
    return rg.protein_rmsd(_pairs(t), t.ligand(), BY, radius=1.0)


# the best rotation as the eigenvector of the largest eigenvalue of the 4 x 4 quaternion matrix, by power iteration
_COV = ", ".join(f"covar_pop({a}, m{b}) AS s{a}{b}" for a in XYZ for b in XYZ)
_QUATERNION = f"""s AS (SELECT cid, count(*) AS n, {", ".join(f"avg({c}) AS a{c}, avg(m{c}) AS q{c}_" for c in XYZ)}, {_COV},
  {"+".join(f"var_pop({c})+var_pop(m{c})" for c in XYZ)} AS c FROM pts GROUP BY 1),
k AS (SELECT *, sxx+syy+szz AS k00, syz-szy AS k01, szx-sxz AS k02, sxy-syx AS k03, sxx-syy-szz AS k11, sxy+syx AS k12, szx+sxz AS k13, syy-sxx-szz AS k22, syz+szy AS k23, szz-sxx-syy AS k33 FROM s),
p(cid, i, qw, qx, qy, qz) AS (SELECT cid, 0, 1.0::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE FROM k UNION ALL
  SELECT cid, i + 1, w/m, x/m, y/m, z/m FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS m FROM (SELECT p.cid, i, (k00+c)*qw+k01*qx+k02*qy+k03*qz AS w, k01*qw+(k11+c)*qx+k12*qy+k13*qz AS x,
    k02*qw+k12*qx+(k22+c)*qy+k23*qz AS y, k03*qw+k13*qx+k23*qy+(k33+c)*qz AS z FROM p JOIN k ON p.cid = k.cid WHERE i < 300))),
r AS (SELECT k.*, qw*qw+qx*qx-qy*qy-qz*qz AS r0, 2*(qx*qy-qw*qz) AS r1, 2*(qx*qz+qw*qy) AS r2, 2*(qx*qy+qw*qz) AS r3, qw*qw-qx*qx+qy*qy-qz*qz AS r4, 2*(qy*qz-qw*qx) AS r5,
  2*(qx*qz-qw*qy) AS r6, 2*(qy*qz+qw*qx) AS r7, qw*qw-qx*qx-qy*qy+qz*qz AS r8 FROM k JOIN p ON p.cid = k.cid WHERE i = 300)"""


@query("kabsch_fit", f"""WITH RECURSIVE {POINTS}, {_QUATERNION}
SELECT cid, n, round(sqrt(greatest(c - 2*(r0*sxx+r3*sxy+r6*sxz+r1*syx+r4*syy+r7*syz+r2*szx+r5*szy+r8*szz), 0)), 6) AS rmsd, {", ".join(f"round(r{i}, 6) AS r{i}" for i in range(9))},
  round(qx_-(r0*ax+r1*ay+r2*az), 6) AS t0, round(qy_-(r3*ax+r4*ay+r5*az), 6) AS t1, round(qz_-(r6*ax+r7*ay+r8*az), 6) AS t2 FROM r""")
def kabsch_fit(t: Tables):
    return rg.kabsch(_pairs(t), BY).select("cid", "n", "rmsd", *[F.col("r")[i].alias(f"r{i}") for i in range(9)], *[F.col("t")[i].alias(f"t{i}") for i in range(3)])


@query("kabsch_recovers_rotation", f"WITH {POINTS} SELECT cid, count(*) AS n, 0.0 AS rmsd, 1.0 AS t0, -2.0 AS t1, 0.5 AS t2 FROM pts GROUP BY 1")
def kabsch_recovers_rotation(t: Tables):
    """A known rotation and shift of the points; the fit must give the shift and no error."""
    r = v.matrix_from_axis_angle((F.lit(0.3), F.lit(-0.7), F.lit(1.1)))
    moved = v.add(v.matrix_times_column(r, v.vec()), (F.lit(1.0), F.lit(-2.0), F.lit(0.5)))
    pairs = t.points().select("cid", *[F.col(c).alias("a_" + c) for c in XYZ], *[m.alias("b_" + c) for c, m in zip(XYZ, moved)])
    fit = rg.kabsch_rmsd(pairs, BY, return_transform=True)
    return fit.select("cid", "n", F.round("rmsd", 4).alias("rmsd"), *[F.col("t")[i].alias(f"t{i}") for i in range(3)])


@query("align_to_reference", f"WITH {LIG} SELECT cid, count(*) AS atoms, true AS on_reference FROM pts GROUP BY 1")
def align_to_reference(t: Tables):
    """A turned and shifted copy of each complex must come back onto the reference."""
    r = v.matrix_from_axis_angle((F.lit(-0.4), F.lit(0.9), F.lit(0.2)))
    moved = v.add(v.matrix_times_column(r, v.vec()), (F.lit(3.0), F.lit(4.0), F.lit(-5.0)))
    ref = t.points().select("cid", F.col("idx").alias("residue_idx"), *XYZ)
    model = t.points().select("cid", F.col("idx").alias("residue_idx"), *[m.alias(c) for c, m in zip(XYZ, moved)])
    lig = t.ligand().select("cid", "lig_idx", *XYZ)
    atoms, _, _ = rg.align_to_reference(ref, lig, model, model, lig, BY)
    both = atoms.join(ref.select("cid", "residue_idx", *[F.col(c).alias("r" + c) for c in XYZ]), ["cid", "residue_idx"])
    close = v.dist(v.vec(), v.vec("r")) < 1e-6
    return both.groupBy("cid").agg(F.count(F.lit(1)).alias("atoms"), F.bool_and(close).alias("on_reference"))


@query("match_atoms", f"""WITH {POINTS}, r AS (SELECT cid, idx % 50 // 5 AS res, {NAME_SQL} AS name, idx FROM pts), m AS (SELECT * FROM r WHERE res < 8 AND idx % 13 <> 4)
SELECT r.cid, count(CASE WHEN m.idx IS NULL THEN 1 END) AS unmatched, count(m.idx) AS matched, count(CASE WHEN m.idx IS NULL THEN 1 END) > 10 AS suspicious FROM r LEFT JOIN m ON r.cid=m.cid AND r.res=m.res AND r.name=m.name WHERE r.res < 8 GROUP BY 1""")
def match_atoms(t: Tables):
    p = t.points().select("cid", F.floor(F.col("idx") % 50 / 5).alias("residue_idx"), _name().alias("atom_name"), F.lit("C").alias("element"), "idx", *XYZ)
    model = p.where("residue_idx < 8 AND idx % 13 <> 4")
    return rg.match_atoms(p, model, BY)[1]


@query("center_of_mass", f"""WITH {POINTS}, m AS (SELECT *, CASE idx % 5 WHEN 0 THEN 12.011 WHEN 1 THEN 14.007 WHEN 2 THEN 15.999 WHEN 3 THEN 1.008 ELSE 35.453 END AS w FROM pts)
SELECT cid, round(sum(x*w)/sum(w),6) AS x, round(sum(y*w)/sum(w),6) AS y, round(sum(z*w)/sum(w),6) AS z FROM m GROUP BY 1""")
def center_of_mass(t: Tables):
    return rg.center_of_mass(t.points().withColumn("symbol", _element("idx")), BY)


@query("centered_coordinates", f"""WITH {LIG}, c AS (SELECT cid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM lig GROUP BY 1)
SELECT cid, idx, round(x-cx,6) AS x, round(y-cy,6) AS y, round(z-cz,6) AS z, round(cx,6) AS center_x FROM pts JOIN c USING (cid)""")
def centered_coordinates(t: Tables):
    return rg.center_on(t.points(), t.ligand(), BY).select("cid", "idx", *XYZ, "center_x")


@query("complex_statistics", f"""WITH {LIG}, p AS (SELECT cid, max(sqrt(x*x+y*y+z*z)) AS radius_protein FROM pts GROUP BY 1), c AS (SELECT cid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM lig GROUP BY 1),
l AS (SELECT cid, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS radius_molecule, max(sqrt(mx*mx+my*my+mz*mz)) AS center_distance FROM lig JOIN c USING (cid) GROUP BY 1),
u AS (SELECT 'radius_protein' AS statistic, radius_protein AS v FROM p UNION ALL SELECT 'radius_molecule', radius_molecule FROM l UNION ALL SELECT 'center_distance', center_distance FROM l UNION ALL SELECT 'rmsd_matching', 0.0 FROM l)
SELECT statistic, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(max(v),6) AS max FROM u GROUP BY 1""")
def complex_statistics(t: Tables):
    return rg.complex_statistics(t.points(), t.ligand(), BY)


# --------------------------------------------------------------------- chain geometry
def _backbone(t: Tables):
    """Residues of one chain per complex: N from x y z, CA from l*, C from m*."""
    return t.points().select(
        "cid", (F.col("idx") % 50).alias("pos"), *[F.col(c).alias("n_" + c) for c in XYZ], *[F.col("l" + c).alias("ca_" + c) for c in XYZ],
        *[F.col("m" + c).alias("c_" + c) for c in XYZ],
    )


@query("chain_orientations", f"""WITH {POINTS}, w AS (SELECT cid, idx, lead(x) OVER o - x AS dx, lead(y) OVER o - y AS dy, lead(z) OVER o - z AS dz FROM pts WINDOW o AS (PARTITION BY cid ORDER BY idx))
SELECT cid, idx AS pos, round(coalesce(dx/sqrt(dx*dx+dy*dy+dz*dz+1e-8),0),6)+0.0 AS forward_x, round(coalesce(dy/sqrt(dx*dx+dy*dy+dz*dz+1e-8),0),6)+0.0 AS forward_y FROM w""")
def chain_orientations(t: Tables):
    out = bb.orientations(t.points().withColumn("pos", F.col("idx")), BY)
    return out.select("cid", "pos", "forward_x", "forward_y")


def dih_sql(p: list[tuple[str, str, str]]) -> str:
    """SQL for atan2(|b2| b1.(b2 x b3), (b1 x b2).(b2 x b3)) of four points."""
    b = [[f"({q[i]}-{p_[i]})" for i in range(3)] for p_, q in zip(p, p[1:])]

    def cross(a, c):
        return [f"({a[1]}*{c[2]}-{a[2]}*{c[1]})", f"({a[2]}*{c[0]}-{a[0]}*{c[2]})", f"({a[0]}*{c[1]}-{a[1]}*{c[0]})"]

    def dot(a, c):
        return "(" + "+".join(f"{i}*{j}" for i, j in zip(a, c)) + ")"

    n2 = cross(b[1], b[2])
    return f"atan2(sqrt({dot(b[1], b[1])})*{dot(b[0], n2)}, {dot(cross(b[0], b[1]), n2)})"


_P = {"n": [f"{c}" for c in XYZ], "ca": [f"l{c}" for c in XYZ], "c": [f"m{c}" for c in XYZ], "pc": ["pmx", "pmy", "pmz"], "nn": ["nx", "ny", "nz"], "nca": ["nlx", "nly", "nlz"]}


@query("backbone_dihedrals", f"""WITH {POINTS}, w AS (SELECT *, lag(mx) OVER o AS pmx, lag(my) OVER o AS pmy, lag(mz) OVER o AS pmz, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(z) OVER o AS nz,
  lead(lx) OVER o AS nlx, lead(ly) OVER o AS nly, lead(lz) OVER o AS nlz FROM pts WINDOW o AS (PARTITION BY cid ORDER BY idx))
SELECT cid, idx % 50 AS pos, round(coalesce({dih_sql([_P['pc'], _P['n'], _P['ca'], _P['c']])},0),5) AS phi, round(coalesce({dih_sql([_P['n'], _P['ca'], _P['c'], _P['nn']])},0),5) AS psi,
  round(coalesce(cos({dih_sql([_P['ca'], _P['c'], _P['nn'], _P['nca']])}),1),5)+0.0 AS cos_omega FROM w""")
def backbone_dihedrals(t: Tables):
    out = bb.backbone_dihedrals(_backbone(t), BY)
    return out.select("cid", "pos", *[F.round(c, 5).alias(c) for c in ("phi", "psi", "cos_omega")])


def _unit_sql(x: str, eps: str = "") -> str:
    return ", ".join(f"{x}{c}/sqrt({x}x*{x}x+{x}y*{x}y+{x}z*{x}z{eps}) AS {{}}{c}" for c in XYZ)


def _cross_sql(a: str, b: str, out: str) -> str:
    return f"{a}y*{b}z-{a}z*{b}y AS {out}x, {a}z*{b}x-{a}x*{b}z AS {out}y, {a}x*{b}y-{a}y*{b}x AS {out}z"


_DIFF = ", ".join(f"{c}-l{c} AS p{c}, {c}-m{c} AS q{c}" for c in XYZ)
CB_SQL = f"""WITH {POINTS}, s1 AS (SELECT *, {_DIFF} FROM pts), s2 AS (SELECT *, {_unit_sql('p').format(*['e']*3)} FROM s1),
s3 AS (SELECT *, {_cross_sql('q', 'e', 'o')} FROM s2), s4 AS (SELECT *, {_unit_sql('o').format(*['n']*3)} FROM s3), s5 AS (SELECT *, {_cross_sql('n', 'e', 'w')} FROM s4),
cb AS (SELECT cid, idx % 50 AS pos, {", ".join(f"l{c}+1.522*cos(1.927)*e{c}+1.522*sin(1.927)*cos(-2.143)*w{c}-1.522*sin(1.927)*sin(-2.143)*n{c} AS {c}" for c in XYZ)} FROM s5)
SELECT a.cid, a.pos AS i, b.pos AS j, round({DAB},6) AS distance FROM cb a JOIN cb b ON a.cid=b.cid AND a.pos<b.pos WHERE {DAB} < 4"""
_DIFF2 = ", ".join(f"m{c}-l{c} AS p{c}, {c}-l{c} AS q{c}" for c in XYZ)
DIR_SQL = f"""WITH {POINTS}, s1 AS (SELECT *, {_DIFF2} FROM pts), s2 AS (SELECT *, {_unit_sql('p', '+1e-8').format(*['c']*3)}, {_unit_sql('q', '+1e-8').format(*['n']*3)} FROM s1),
s3 AS (SELECT *, cx+nx AS hx, cy+ny AS hy, cz+nz AS hz, {_cross_sql('c', 'n', 'k')} FROM s2),
s4 AS (SELECT *, {_unit_sql('h', '+1e-8').format(*['u']*3)}, {_unit_sql('k', '+1e-8').format(*['w']*3)} FROM s3)
SELECT cid, idx % 50 AS pos, round(-ux*sqrt(1/3.0)-wx*sqrt(2/3.0),6) AS s_x, round(-uy*sqrt(1/3.0)-wy*sqrt(2/3.0),6) AS s_y, round(-uz*sqrt(1/3.0)-wz*sqrt(2/3.0),6) AS s_z, round(cx,6) AS e1_x FROM s4"""


@query("virtual_cb_contacts", CB_SQL)
def virtual_cb_contacts(t: Tables):
    return st.contacts(_backbone(t), BY, thr=4.0)[0]


@query("side_chain_directions", DIR_SQL)
def side_chain_directions(t: Tables):
    out = v.with_side_chain_direction(_backbone(t), "s_", "n_", "ca_", "c_")
    return v.with_local_frame(out, "n_", "ca_", "c_").select("cid", "pos", "s_x", "s_y", "s_z", "e1_x")


@query("local_frame_is_orthonormal", f"WITH {POINTS} SELECT cid, count(*) AS n, true AS orthogonal, true AS round_trip FROM pts GROUP BY 1")
def local_frame_is_orthonormal(t: Tables):
    f = v.with_local_frame(_backbone(t), "n_", "ca_", "c_")
    e = [v.vec(p) for p in ("e1_", "e2_", "e3_")]
    ok = (F.abs(v.dot(e[0], e[1])) < 1e-6) & (F.abs(v.dot(e[0], e[2])) < 1e-6)
    back = v.from_local(v.to_local(v.vec("n_"), v.vec("ca_"), e), v.vec("ca_"), e)
    f = f.select("cid", ok.alias("ok"), (v.dist(back, v.vec("n_")) < 1e-3).alias("same"))
    return f.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("orthogonal"), F.bool_and("same").alias("round_trip"))


@query("concatenate_chains", f"""WITH {POINTS}, h AS (SELECT cid, chain, count(*) AS n, row_number() OVER (PARTITION BY cid ORDER BY chain <> 3, min(idx)) AS o FROM pts GROUP BY 1,2),
s AS (SELECT *, sum(n+10) OVER (PARTITION BY cid ORDER BY o) - (n+10) AS start FROM h)
SELECT p.cid, p.chain, p.idx, (start + row_number() OVER (PARTITION BY p.cid, p.chain ORDER BY idx) - 1)::BIGINT AS position FROM pts p JOIN s ON p.cid=s.cid AND p.chain=s.chain""")
def concatenate_chains(t: Tables):
    b = t.points().select("cid", "chain", "idx", F.col("idx").alias("first_line"), F.col("x").alias("ca_x"))
    out = bb.concatenate_chains(b, 3, BY, index="idx")
    return out.where("idx IS NOT NULL").select("cid", "chain", "idx", "position")


@query("mask_coordinate_range", f"WITH {POINTS} SELECT cid, count(*) AS n, count(CASE WHEN idx % 50 NOT BETWEEN 10 AND 19 THEN x END) AS kept FROM pts GROUP BY 1")
def mask_coordinate_range(t: Tables):
    m = bb.mask_range(_backbone(t), 10, 19)
    return m.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.count("n_x").alias("kept"))


RES = ("ARG", "LEU", "VAL", "TYR", "ALA")


def _side_chain_atoms(t: Tables):
    """Ten atoms per residue named along the side chain of its residue type."""
    order = F.array(*[F.array(*[F.lit(a) for a in _names(r)]) for r in RES])
    place = (F.col("idx") % 10).cast("int")
    kind = F.floor(F.col("idx") / 10) % len(RES)
    name = F.get(F.get(order, kind.cast("int")), place)
    return t.points().select(
        F.col("cid").alias("structure_id"), F.lit("A").alias("chain"), F.floor(F.col("idx") / 10).alias("resid"), F.lit(" ").alias("insertion"),
        F.lit(" ").alias("hetero"), F.get(F.array(*[F.lit(r) for r in RES]), kind.cast("int")).alias("resname"), name.alias("atom_name"), "idx", *XYZ,
    ).where("atom_name IS NOT NULL")


def _names(res: str) -> list[str]:
    return (["N", "CA", "C", "CB"] + list(k.SIDE_CHAIN.get(res, ())))[:10]


def _chi_sql() -> str:
    """One select per residue type and chi, straight from the atom order of the binding."""
    parts = []
    for n, res in enumerate(RES):
        names = _names(res)
        path = list(k.CHI_PATH.get(res, ()))
        for chi in range(1, len(path) - 2):
            four = [names.index(a) for a in path[chi - 1:chi + 3]]
            pts = [[f"max(CASE WHEN idx%10={p} THEN {c} END)" for c in XYZ] for p in four]
            main = f"(({dih_sql(pts)} + 2*pi()) % (2*pi()))"
            alt = k.CHI_ALTERNATIVE.get(res)
            if alt and alt[0] == chi:
                q = [*pts[:3], [f"max(CASE WHEN idx%10={names.index(alt[1])} THEN {c} END)" for c in XYZ]]
                other = f"(({dih_sql(q)} + 2*pi()) % (2*pi()))"
                main, second = f"greatest({main},{other})", f"least({main},{other})"
            else:
                second = "0.0"
            parts.append(f"SELECT cid AS structure_id, idx//10 AS resid, {chi} AS chi, round({main},5) AS angle, round({second},5) AS alt_angle FROM pts WHERE (idx//10)%5={n} GROUP BY 1,2")
    return f"WITH {POINTS} " + " UNION ALL ".join(parts)


@query("side_chain_dihedrals", _chi_sql())
def side_chain_dihedrals(t: Tables):
    """Without the mask column, a masked angle is null; a chi with one last atom has the alternative 0."""
    out = bb.chi_angles(_side_chain_atoms(t))
    two = F.concat_ws(" ", "resname", "chi").isin(*[f"{res} {chi}" for res, (chi, _) in k.CHI_ALTERNATIVE.items()])
    shown = {"angle": F.col("mask") == 1, "alt_angle": (F.col("mask") == 1) | ~two}
    return out.select("structure_id", "resid", "chi", *[F.when(ok, F.round(c, 5)).alias(c) for c, ok in shown.items()])


@query("rotate_side_chains", f"""WITH {POINTS} SELECT count(*) AS angles, 0 AS wrong FROM (SELECT 1 FROM pts WHERE (idx//10)%5 = 0 AND idx%10=0 UNION ALL SELECT 1 FROM pts WHERE (idx//10)%5 = 1 AND idx%10=0 UNION ALL SELECT 1 FROM pts WHERE (idx//10)%5 IN (2,3) AND idx%10=0)""")
def rotate_side_chains(t: Tables):
    """Turning chi1 by 0.5 must add 0.5 to chi1 of every residue that has one."""
    atoms = _side_chain_atoms(t)
    keys = ["structure_id", "chain", "resid", "insertion"]
    turns = atoms.select(*keys).distinct().withColumn("angles", F.array(F.lit(0.5), *[F.lit(None).cast("double")] * 4))
    before = bb.chi_angles(atoms).where("chi = 1 AND mask = 1").select(*keys, F.col("angle").alias("a0"), F.col("alt_angle").alias("b0"))
    after = bb.chi_angles(bb.rotate_chi(atoms, turns)).where("chi = 1 AND mask = 1").select(*keys, F.col("angle").alias("a1"), F.col("alt_angle").alias("b1"))

    def off(p, q):
        return F.abs(F.sin((F.col(p) - F.col(q) - 0.5) / 2)) > 1e-3

    wrong = off("a1", "a0") & off("a1", "b0")  # two-ended angles may trade places
    return before.join(after, keys).agg(F.count(F.lit(1)).alias("angles"), F.count_if(wrong).cast("int").alias("wrong"))


@query("distance_features", f"WITH {POINTS} SELECT cid, idx, round(exp(-pow((sqrt(x*x+y*y+z*z)-0)/(20.0/16),2)),6) AS rbf0, round(exp(-0.5/pow(5.0/49,2)*pow(sqrt(x*x+y*y+z*z)-5.0/49*10,2)),6) AS gauss10, round(cos(idx*exp(-2*ln(10000)/16)),6) AS pos1, round(exp(-greatest((sqrt(x*x+y*y+z*z)-6)/10,0)),6) AS decay FROM pts")
def distance_features(t: Tables):
    d = v.norm(v.vec())
    return t.points().select(
        "cid", "idx", v.radial_basis(d, 0.0, 20.0)[0].alias("rbf0"), v.gaussian_smearing(d)[10].alias("gauss10"),
        v.relative_position(F.col("idx"))[1].alias("pos1"), v.distance_decay(d).alias("decay"),
    )


@query("unit_vectors", f"WITH {POINTS} SELECT cid, idx, round(x/sqrt(x*x+y*y+z*z+1e-8),6) AS ux, round(y/sqrt(x*x+y*y+z*z+1e-8),6) AS uy FROM pts")
def unit_vectors(t: Tables):
    u = v.unit(v.vec())
    return t.points().select("cid", "idx", u[0].alias("ux"), u[1].alias("uy"))


@query("apply_transform", f"WITH {POINTS} SELECT cid, idx, round(-y+1,6) AS x, round(x+2,6) AS y, round(z+3,6) AS z FROM pts")
def apply_transform(t: Tables):
    half = 0.7071067811865476
    r = v.matrix_from_quaternion(F.lit(half), F.lit(0.0), F.lit(0.0), F.lit(half))  # quarter turn about z
    transforms = t.points().select("cid").distinct().select("cid", r.alias("r"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("t"))
    return rg.apply_transform(t.points().select("cid", "idx", *XYZ), transforms, BY)


@query("atom_codes", f"""WITH {POINTS} SELECT cid, idx, CASE (idx//10)%5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 19 WHEN 3 THEN 18 ELSE 0 END AS residue,
  CASE idx%5 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE 16 END AS element, CASE idx%5 WHEN 0 THEN 8 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 13 ELSE 2 END AS atom_class,
  CASE idx%5 WHEN 0 THEN 17 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 26 ELSE 2 END AS atom_name FROM pts""")
def atom_codes(t: Tables):
    res = F.get(F.array(*[F.lit(r) for r in RES]), (F.floor(F.col("idx") / 10) % 5).cast("int"))
    return t.points().select("cid", "idx", tx.atom_codes(res, _element("idx"), _name()).alias("c")).select("cid", "idx", "c.*")


# --------------------------------------------------------------------- graphs
GRAPH = """b AS (SELECT r_regionkey AS mol, -1-r_regionkey AS a, n_nationkey::BIGINT AS b, 1 AS bond_type FROM region JOIN nation ON n_regionkey=r_regionkey
  UNION ALL SELECT n_regionkey, n_nationkey, 1000+s_suppkey, 1 FROM supplier JOIN nation ON s_nationkey=n_nationkey
  UNION ALL SELECT n_regionkey, 1000+s_suppkey, 1000000000+c_custkey, 1 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s.s_nationkey=c_nationkey)"""


def _bonds(t: Tables):
    """Region - nation - supplier trees with customers on one supplier per nation."""
    c = F.col
    n = t.nation.select("n_nationkey", "n_regionkey")
    top = n.select(c("n_regionkey").alias("mol"), (-1 - c("n_regionkey")).cast("long").alias("a"), c("n_nationkey").cast("long").alias("b"))
    sup = t.supplier.join(n, c("s_nationkey") == c("n_nationkey")).select(c("n_regionkey").alias("mol"), c("n_nationkey").cast("long").alias("a"), (c("s_suppkey") + 1000).alias("b"))
    hub = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("hub"))
    cus = t.customer.join(n, c("c_nationkey") == c("n_nationkey")).join(hub, c("s_nationkey") == c("c_nationkey")).select(
        c("n_regionkey").alias("mol"), (c("hub") + 1000).alias("a"), (c("c_custkey") + 1000000000).alias("b")
    )
    return top.unionByName(sup).unionByName(cus).withColumn("bond_type", F.lit(1))


ROTATABLE = f"""WITH {GRAPH}, tot AS (SELECT mol, count(*)+1 AS n FROM b GROUP BY 1), d3 AS (SELECT mol, a AS node, count(*) AS k FROM b WHERE b >= 1000000000 GROUP BY 1,2),
e AS (SELECT b.mol, b.a AS parent, b.b AS atom, 1+coalesce(d3.k,0) AS below FROM b LEFT JOIN d3 ON d3.node=b.b WHERE b.a >= 0 AND b.b < 1000000000
  UNION ALL SELECT b.mol, b.a, b.b, 1+coalesce(s.k,0) FROM b LEFT JOIN (SELECT x.a AS nat, sum(1+coalesce(d3.k,0)) AS k FROM b x LEFT JOIN d3 ON d3.node=x.b WHERE x.a>=0 AND x.b < 1000000000 AND x.a < 1000 GROUP BY 1) s ON s.nat=b.b WHERE b.a < 0)
SELECT e.mol, atom, parent, least(below, n-below)::BIGINT AS smaller FROM e JOIN tot USING (mol) WHERE least(below, n-below) >= 2 AND atom < 1000000000"""


@query("rotatable_bonds", ROTATABLE)
def rotatable_bonds(t: Tables):
    return gr.rotatable_bonds(_bonds(t), ["mol"]).select("mol", "atom", "parent", "smaller")


@query("rotation_masks", ROTATABLE.replace("atom, parent, least(below, n-below)::BIGINT AS smaller",
       "CASE WHEN below < n-below THEN parent ELSE atom END AS src, CASE WHEN below < n-below THEN atom ELSE parent END AS dst, least(below, n-below)::BIGINT AS atoms"))
def rotation_masks(t: Tables):
    return gr.rotation_masks(_bonds(t), ["mol"]).groupBy("mol", "src", "dst").agg(F.count(F.lit(1)).alias("atoms"))


# --------------------------------------------------------------------- learning
def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("y"))


@query("pca_on_train")
def pca_on_train(t: Tables):
    df = _vectors(t)
    model = ln.fit_pca(df.where("id % 5 <> 0"), k=8)
    return ln.apply_pca(model, df.where("id % 5 = 0")).select("id", F.transform("components", lambda c: F.round(c, 4)).alias("components"))


@query("knn_regression", """WITH e AS (SELECT vec_id AS id, embedding AS v, label AS y FROM embeddings), d AS (SELECT q.id, p.id AS pid, p.y, list_sum(list_transform(range(1,65), lambda i: pow(q.v[i]::DOUBLE-p.v[i]::DOUBLE,2))) AS d2 FROM e q JOIN e p ON q.id % 5 = 0 AND p.id % 5 <> 0)
SELECT id, round(avg(y),6) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, pid) AS rn FROM d) WHERE rn <= 5 GROUP BY 1""")
def knn_regression(t: Tables):
    df = _vectors(t)
    return ln.knn_regress(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), 5)


@query("forest_grid_search")
def forest_grid_search(t: Tables):
    df = _vectors(t)
    return ln.grid_search(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), {"maxDepth": [3, 5], "numTrees": [10]}, folds=2)[0]
