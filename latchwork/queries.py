"""Registered queries of the engine over the test tables, and their SQL for DuckDB.

Every query works on all edges of ``sources.graphs.star_edges``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import access, expand, integrity, objects, paging, relationships
from .operators.grants import EDGE, Evaluation, relation_edges
from .plans.dsl import parse
from .plans.schema import Schema, difference, relation_id
from .sources.graphs import SCHEMA, star_edges
from .sources.store import Store
from .sources.tables import settle, shared_dir
from .streaming.deltas import affected_subjects, changed_grants

STAR = Schema.of(SCHEMA)


def _pairs(spark: SparkSession, sf_dir: str, resource_type: str, permission: str) -> DataFrame:
    return access.lookup_resources(STAR, star_edges(spark, sf_dir), resource_type, permission, "user")


def relation_direct(spark, sf_dir):
    return relation_edges(star_edges(spark, sf_dir), "account", "owner", "user").select("subject_id", "resource_id")


def self_permission(spark, sf_dir):
    return _pairs(spark, sf_dir, "account", "view")


def arrow_relation(spark, sf_dir):
    return _pairs(spark, sf_dir, "nation", "audit")


def arrow_permission(spark, sf_dir):
    return _pairs(spark, sf_dir, "nation", "manage")


def lookup_all_order_view(spark, sf_dir):
    return _pairs(spark, sf_dir, "order", "view")


def lookup_resources_user(spark, sf_dir):
    """All orders that user 3 can view, from that user's edges alone."""
    one = spark.range(3, 4).select(F.col("id").alias("subject_id"))
    return access.lookup_resources(STAR, star_edges(spark, sf_dir), "order", "view", "user", one).select("resource_id")


def lookup_subjects_order(spark, sf_dir):
    """All users that can view order 7."""
    one = spark.range(7, 8).select(F.col("id").alias("resource_id"))
    return access.lookup_subjects(STAR, star_edges(spark, sf_dir), "order", "view", "user", one).select("subject_id")


def count_resources_by_user(spark, sf_dir):
    return access.count_by(_pairs(spark, sf_dir, "order", "view"), "subject_id")


def count_subjects_by_order(spark, sf_dir):
    return access.count_by(_pairs(spark, sf_dir, "order", "view"), "resource_id")


def count_bounded(spark, sf_dir):
    return access.count_by(_pairs(spark, sf_dir, "order", "view"), "subject_id", 100)


def check_batch(spark, sf_dir):
    """May the user of a customer's number view that customer's orders? One demand for each order."""
    demands = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("resource_id"))
    return access.check(STAR, star_edges(spark, sf_dir), demands, "order", "view", "user").select("subject_id", "resource_id", "allowed")


def folder_view_recursive(spark, sf_dir):
    return _pairs(spark, sf_dir, "folder", "view")


def folder_mutual_recursion(spark, sf_dir):
    run = Evaluation(STAR, star_edges(spark, sf_dir), "user")
    run.grants("folder", "edit")
    both = [run.grants("folder", p).select(F.lit(p).alias("permission"), "subject_id", "resource_id") for p in ("edit", "share")]
    return both[0].union(both[1])


def _read(spark, sf_dir, **filters):
    return relationships.read(STAR, star_edges(spark, sf_dir), **filters).select(*EDGE)


def read_relationships_forward(spark, sf_dir):
    return _read(spark, sf_dir, subject_type="nation", subject_id=4)


def read_relationships_reverse(spark, sf_dir):
    return _read(spark, sf_dir, resource_type="account", resource_id=7)


def read_relationships_partial(spark, sf_dir):
    return _read(spark, sf_dir, subject_type="user")


def read_relationships_exact(spark, sf_dir):
    return _read(spark, sf_dir, subject_type="user", subject_id=2, relation="owner", resource_type="account", resource_id=2)


def relationship_page(spark, sf_dir):
    """The third page of 50 of all edges from users, by keyset: the rows after the 100th."""
    rows = relationships.read(STAR, star_edges(spark, sf_dir), subject_type="user")
    keys, bound = ("spec", "major", "minor"), None
    for _ in range(2):
        got = relationships.keyset_page(rows, keys, first=50, after=bound)[0].limit(50).collect()
        bound = tuple(got[-1][k] for k in keys) if got else bound
    page, size, _ = relationships.keyset_page(rows, keys, first=50, after=bound)
    return page.limit(size).select(*EDGE)


def least_path_page(spark, sf_dir):
    """The first 40 orders of user 3, by least path."""
    rows = paging.least_paths(STAR, star_edges(spark, sf_dir), "order", "view", "user", 3)
    last = F.element_at("path", -1)
    flat = F.array_join(F.transform("path", lambda s: s["through"]), "/")
    best = rows.orderBy("path", "resource_id").limit(40)
    return best.select("resource_id", flat.alias("through"), last["through"].cast("long").alias("granted_on"))


def expand_leaf_subjects(spark, sf_dir):
    """Leaves of the trees of order.view for all orders."""
    edges = star_edges(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("resource_id"))
    _, leaves = expand.expand(STAR, edges, "order", "view", orders, most_nodes=None)
    return leaves.select(F.col("root_id").alias("resource_id"), "path", "subject_id")


def _changes(spark, sf_dir) -> DataFrame:
    """Updates of order edges: each order is touched for its customer's neighbour, and old edges of even orders go."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    edge = lambda op, who: orders.select(F.lit(op).alias("op"), F.lit("account").alias("subject_type"), who.cast("long").alias("subject_id"), F.lit("account").alias("relation"), F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("long").alias("resource_id"))
    touched = edge("touch", F.col("o_custkey") - F.col("o_custkey") % 2)
    gone = edge("delete", F.col("o_custkey")).where((F.col("resource_id") % 2 == 0) & (F.col("subject_id") % 2 == 1))
    return touched.union(gone).distinct()


def _store(spark) -> Store:
    """A new store below the shared folder, with the schema of the test tables as its version 1."""
    store = Store(spark, f"{shared_dir(spark)}/latchwork-{uuid.uuid4().hex}/store")
    store.write_schema(SCHEMA)
    return store


def _longs(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col(c).cast("long").alias(c) if c.endswith("_id") else c for c in EDGE])


def _written(spark, sf_dir) -> DataFrame:
    store = _store(spark)
    store.write_relationships(relation_edges(star_edges(spark, sf_dir), "order", "account").withColumn("op", F.lit("create")))
    token = store.write_relationships(_changes(spark, sf_dir))
    return _longs(store.snapshot("at-exact-snapshot", token).edges)


def write_touch_delete(spark, sf_dir):
    return _written(spark, sf_dir)


def delete_object(spark, sf_dir):
    """All edges but those of nation 4."""
    store = _store(spark)
    store.write_relationships(star_edges(spark, sf_dir).withColumn("op", F.lit("touch")))
    store.delete_object("nation", "4")
    return _longs(store.snapshot("fully-consistent").edges)


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two copies of all edges that each lack some: every 7th resource's, every 11th subject's."""
    edges = star_edges(spark, sf_dir)
    return edges.where("resource_id % 7 <> 3"), edges.where("subject_id % 11 <> 5")


def dangling_halves(spark, sf_dir):
    return integrity.dangling(*_halves(spark, sf_dir))


def dangling_report(spark, sf_dir):
    return integrity.dangling(*_halves(spark, sf_dir)).groupBy("half", "relation").agg(F.count("*").alias("n"))


def relation_in_use(spark, sf_dir):
    return integrity.relation_counts(*_halves(spark, sf_dir))


CHANGED = SCHEMA.replace("  relation manager: user                // user_id = n_nationkey\n", "").replace("manager + region->manage", "region->manage").replace("relation owner: user                  // user u owns", "relation owner: user | region  // user u owns")


def schema_delta(spark, sf_dir):
    delta = difference(STAR, Schema(parse(CHANGED)))["relations"]
    rows = [(change, relation_id(r)) for change, found in sorted(delta.items()) for r in sorted(found, key=relation_id)]
    return spark.createDataFrame(rows, "change string, relation_id string")


def snapshot_as_of(spark, sf_dir):
    """Order edges as of the third of four writes: each is added at 1 + its number mod 4, and odd ones go two writes later."""
    rows = relation_edges(star_edges(spark, sf_dir), "order", "account")
    added = F.col("resource_id") % 4 + 1
    store, tokens = _store(spark), []
    for v in range(1, 5):
        gone = rows.where((added == v - 2) & (F.col("resource_id") % 2 == 1)).withColumn("op", F.lit("delete"))
        tokens.append(store.write_relationships(rows.where(added == v).withColumn("op", F.lit("create")).union(gone)))
    return _longs(store.snapshot("at-exact-snapshot", tokens[2]).edges)


def dependency_frontier(spark, sf_dir):
    """The newest version among the relations that each permission reads, after one write for each relation by name."""
    edges, store = star_edges(spark, sf_dir), _store(spark)
    for rt, name in sorted(STAR.relations):
        store.write_relationships(relation_edges(edges, rt, name).withColumn("op", F.lit("touch")))
    now = store.snapshot("fully-consistent")
    return spark.createDataFrame([(f"{t}.{p}", now.frontier((t, p))[1]) for t, p in sorted(STAR.permissions)], "permission string, version long")


def read_schema(spark, sf_dir):
    """Ids of all relation and permission definitions, as the store gives them back."""
    relations, permissions = _store(spark).snapshot().schema.rows()
    return spark.createDataFrame([(r[0],) for r in relations + permissions], "id string")


def read_relationships_reverse_partial(spark, sf_dir):
    return _read(spark, sf_dir, resource_type="nation")


def lookup_subjects_recursive(spark, sf_dir):
    """All users that can view the folders up to 20."""
    some = spark.range(21).select(F.col("id").alias("resource_id"))
    return access.lookup_subjects(STAR, star_edges(spark, sf_dir), "folder", "view", "user", some)


def retract_components(spark, sf_dir):
    """Edges that stay once region 1 goes with its nations, their accounts and the orders of these."""
    edges = star_edges(spark, sf_dir).withColumn("subject_id", F.col("subject_id").cast("string")).withColumn("resource_id", F.col("resource_id").cast("string"))
    owns = edges.where("(relation = 'region' AND resource_type = 'nation') OR (relation = 'nation' AND resource_type = 'account') OR (relation = 'account' AND resource_type = 'order')")
    parts = owns.select(F.col("subject_type").alias("owner_type"), F.col("subject_id").alias("owner_id"), F.col("resource_type").alias("type"), F.col("resource_id").alias("id"))
    roots = spark.createDataFrame([("region", "1")], "type string, id string")
    ends = edges.select(F.col("subject_type").alias("type"), F.col("subject_id").alias("id")).distinct()
    return _longs(objects.retract(edges, ends, parts, roots)[0])


def repair_halves(spark, sf_dir):
    return integrity.repaired(*_halves(spark, sf_dir))


def object_codec(spark, sf_dir):
    """Owners of accounts: ids to numbers and back."""
    edges = star_edges(spark, sf_dir).withColumn("subject_id", F.col("subject_id").cast("string")).withColumn("resource_id", F.col("resource_id").cast("string"))
    known, _ = settle(objects.dictionary(edges), "objects")
    coded = relation_edges(objects.encode(edges, known), "account", "owner", "user").select("subject_id", "resource_id")
    back = objects.decode(objects.decode(coded, known, "subject_id", "user"), known, "resource_id", "account")
    return back.select(F.col("subject_id").cast("long").alias("subject_id"), F.col("resource_id").cast("long").alias("resource_id"))


def affected_by_change(spark, sf_dir):
    """Who may view the orders of customers of nation 1."""
    edges = star_edges(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey = 1").select(F.col("c_custkey").alias("subject_id"))
    changed = relation_edges(edges, "order", "account").join(customers, "subject_id", "left_semi")
    return affected_subjects(STAR, edges, changed, "order", "view", "user")


def grants_changed(spark, sf_dir):
    """Grants of order.view that the updates of ``write_touch_delete`` bring and take."""
    edges = star_edges(spark, sf_dir)
    rest = edges.where("NOT (resource_type = 'order' AND relation = 'account')").select(*EDGE)
    moved = changed_grants(STAR, edges, rest.union(_written(spark, sf_dir)), "order", "view")
    return moved.select("subject_id", "resource_id", "change")


QUERIES = {
    f.__name__: f
    for f in (
        relation_direct, self_permission, arrow_relation, arrow_permission, lookup_all_order_view, lookup_resources_user, lookup_subjects_order,
        count_resources_by_user, count_subjects_by_order, count_bounded, check_batch, folder_view_recursive, folder_mutual_recursion,
        read_relationships_forward, read_relationships_reverse, read_relationships_partial, read_relationships_exact, relationship_page,
        least_path_page, expand_leaf_subjects, write_touch_delete, delete_object, dangling_halves, dangling_report, relation_in_use,
        schema_delta, snapshot_as_of, dependency_frontier, affected_by_change, grants_changed,
        read_schema, read_relationships_reverse_partial, lookup_subjects_recursive, retract_components, repair_halves, object_codec,
    )
}

_EDGES = """
users AS (SELECT DISTINCT user_id AS u FROM events),
edges(subject_type, subject_id, relation, resource_type, resource_id) AS (
  SELECT 'user', CAST(r_regionkey AS BIGINT), 'admin', 'region', CAST(r_regionkey AS BIGINT) FROM region WHERE r_regionkey IN (SELECT u FROM users)
  UNION ALL SELECT 'user', CAST(n_nationkey AS BIGINT), 'manager', 'nation', CAST(n_nationkey AS BIGINT) FROM nation WHERE n_nationkey IN (SELECT u FROM users)
  UNION ALL SELECT 'user', c_custkey, 'owner', 'account', c_custkey FROM customer WHERE c_custkey IN (SELECT u FROM users)
  UNION ALL SELECT 'region', CAST(n_regionkey AS BIGINT), 'region', 'nation', CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'nation', CAST(c_nationkey AS BIGINT), 'nation', 'account', c_custkey FROM customer
  UNION ALL SELECT 'account', o_custkey, 'account', 'order', o_orderkey FROM orders
  UNION ALL SELECT 'user', u, 'owner', 'folder', 3 * u FROM users WHERE 3 * u <= (SELECT max(p_partkey) FROM part)
  UNION ALL SELECT 'folder', p_partkey // 2, 'parent', 'folder', p_partkey FROM part WHERE p_partkey > 1
  UNION ALL SELECT 'folder', max(p_partkey), 'parent', 'folder', 1 FROM part
),
via AS (SELECT subject_id AS s, resource_id AS r, relation AS rel, resource_type AS t, subject_type AS st FROM edges),
region_manage AS (SELECT DISTINCT s, r FROM via WHERE t = 'region' AND rel = 'admin'),
nation_audit AS (SELECT DISTINCT g.s, v.r FROM via v JOIN region_manage g ON v.s = g.r WHERE v.t = 'nation' AND v.rel = 'region'),
nation_manage AS (SELECT s, r FROM via WHERE t = 'nation' AND rel = 'manager' UNION SELECT s, r FROM nation_audit),
account_manage AS (
  SELECT s, r FROM via WHERE t = 'account' AND rel = 'owner'
  UNION SELECT g.s, v.r FROM via v JOIN nation_manage g ON v.s = g.r WHERE v.t = 'account' AND v.rel = 'nation'
),
order_view AS (SELECT DISTINCT g.s, v.r FROM via v JOIN account_manage g ON v.s = g.r WHERE v.t = 'order')
"""
_WITH = f"WITH {_EDGES}"
_RECURSIVE = f"WITH RECURSIVE {_EDGES}"
_E = "subject_type, subject_id, relation, resource_type, resource_id"
_WRITTEN = f""",
before AS (SELECT {_E} FROM edges WHERE resource_type = 'order'),
touched AS (SELECT DISTINCT 'account' AS subject_type, o_custkey - o_custkey % 2 AS subject_id, 'account' AS relation, 'order' AS resource_type, o_orderkey AS resource_id FROM orders),
after AS (
  SELECT {_E} FROM before WHERE NOT (resource_id % 2 = 0 AND subject_id % 2 = 1)
  UNION ALL (SELECT {_E} FROM touched EXCEPT SELECT {_E} FROM before)
)
"""
_SPEC = """
spec AS (SELECT *, row_number() OVER (ORDER BY CASE resource_type || '.' || relation WHEN 'account.owner' THEN 0 WHEN 'folder.owner' THEN 1 WHEN 'nation.manager' THEN 2 ELSE 3 END, resource_id, subject_id) AS n FROM edges WHERE subject_type = 'user')
"""

ORACLE = {
    "relation_direct": f"{_WITH} SELECT s AS subject_id, r AS resource_id FROM via WHERE t = 'account' AND rel = 'owner'",
    "self_permission": f"{_WITH} SELECT s AS subject_id, r AS resource_id FROM account_manage",
    "arrow_relation": f"{_WITH} SELECT s AS subject_id, r AS resource_id FROM nation_audit",
    "arrow_permission": f"{_WITH} SELECT s AS subject_id, r AS resource_id FROM nation_manage",
    "lookup_all_order_view": f"{_WITH} SELECT s AS subject_id, r AS resource_id FROM order_view",
    "lookup_resources_user": f"{_WITH} SELECT r AS resource_id FROM order_view WHERE s = 3",
    "lookup_subjects_order": f"{_WITH} SELECT s AS subject_id FROM order_view WHERE r = 7",
    "count_resources_by_user": f'{_WITH} SELECT s AS subject_id, count(*) AS "count", CAST(-1 AS BIGINT) AS "limit", false AS truncated FROM order_view GROUP BY s',
    "count_subjects_by_order": f'{_WITH} SELECT r AS resource_id, count(*) AS "count", CAST(-1 AS BIGINT) AS "limit", false AS truncated FROM order_view GROUP BY r',
    "count_bounded": f'{_WITH} SELECT s AS subject_id, least(count(*), 100) AS "count", CAST(100 AS BIGINT) AS "limit", count(*) > 100 AS truncated FROM order_view GROUP BY s',
    "check_batch": f"{_WITH} SELECT o_custkey AS subject_id, o_orderkey AS resource_id, v.s IS NOT NULL AS allowed FROM orders LEFT JOIN order_view v ON v.s = o_custkey AND v.r = o_orderkey",
    "folder_view_recursive": f"""{_RECURSIVE}, grow(s, r) AS (
        SELECT s, r FROM via WHERE t = 'folder' AND rel = 'owner'
        UNION SELECT grow.s, v.r FROM grow JOIN via v ON v.s = grow.r AND v.t = 'folder' AND v.rel = 'parent'
      ) SELECT s AS subject_id, r AS resource_id FROM grow""",
    "folder_mutual_recursion": f"""{_RECURSIVE}, grow(p, s, r) AS (
        SELECT p, s, r FROM via, (VALUES ('edit'), ('share')) x(p) WHERE t = 'folder' AND rel = 'owner'
        UNION SELECT CASE grow.p WHEN 'edit' THEN 'share' ELSE 'edit' END, grow.s, v.r FROM grow JOIN via v ON v.s = grow.r AND v.t = 'folder' AND v.rel = 'parent'
      ) SELECT p AS permission, s AS subject_id, r AS resource_id FROM grow""",
    "read_relationships_forward": f"{_WITH} SELECT {_E} FROM edges WHERE subject_type = 'nation' AND subject_id = 4",
    "read_relationships_reverse": f"{_WITH} SELECT {_E} FROM edges WHERE resource_type = 'account' AND resource_id = 7",
    "read_relationships_partial": f"{_WITH} SELECT {_E} FROM edges WHERE subject_type = 'user'",
    "read_relationships_exact": f"{_WITH} SELECT {_E} FROM edges WHERE subject_type = 'user' AND subject_id = 2 AND relation = 'owner' AND resource_type = 'account' AND resource_id = 2",
    "relationship_page": f"{_WITH}, {_SPEC} SELECT {_E} FROM spec WHERE n > 100 AND n <= 150",
    "least_path_page": f"""{_WITH}, rules(kind, o) AS (VALUES ('account.owner', 0)),
      paths AS (
        SELECT o.r AS resource_id, [0, a.s, 2, a.r, 0, 0] AS k, CAST(a.r AS VARCHAR) AS account, 'own' AS how, CAST(a.r AS VARCHAR) AS granted FROM via o JOIN via a ON a.t = 'account' AND a.rel = 'owner' AND a.r = o.s AND a.s = 3 WHERE o.t = 'order'
      ), nations AS (
        SELECT c.r AS account, n.r AS nation, CASE WHEN m.s IS NOT NULL THEN 0 ELSE 1 END AS direct, m.s, CAST(g.s AS VARCHAR) AS region
        FROM via c JOIN via n ON n.t = 'nation' AND n.rel = 'region' AND n.r = c.s
        LEFT JOIN via m ON m.t = 'nation' AND m.rel = 'manager' AND m.r = n.r AND m.s = 3
        LEFT JOIN (SELECT s, r FROM region_manage WHERE s = 3) g ON g.r = n.s
        WHERE c.t = 'account' AND c.rel = 'nation' AND (m.s IS NOT NULL OR g.s IS NOT NULL)
      ), all_paths AS (
        SELECT o.r AS resource_id, CAST(o.s AS VARCHAR) AS account, CASE WHEN a.s IS NOT NULL THEN 0 ELSE 1 END AS arm, CAST(n.nation AS VARCHAR) AS nation, n.direct, n.region
        FROM via o LEFT JOIN via a ON a.t = 'account' AND a.rel = 'owner' AND a.r = o.s AND a.s = 3 LEFT JOIN nations n ON n.account = o.s
        WHERE o.t = 'order' AND (a.s IS NOT NULL OR n.account IS NOT NULL)
      ), named AS (
        SELECT resource_id, account, arm, nation, direct,
          CASE WHEN arm = 0 THEN account || '/' || account || '/' || account
               WHEN direct = 0 THEN account || '/' || account || '/' || nation || '/' || nation
               ELSE account || '/' || account || '/' || nation || '/' || region || '/' || region END AS through,
          CASE WHEN arm = 0 THEN CAST(account AS BIGINT) WHEN direct = 0 THEN CAST(nation AS BIGINT) ELSE CAST(region AS BIGINT) END AS granted_on
        FROM all_paths
      )
      SELECT resource_id, through, granted_on FROM named ORDER BY account, arm, nation, direct, resource_id LIMIT 40""",
    "expand_leaf_subjects": f"""{_WITH}, o AS (SELECT r AS o, s AS a FROM via WHERE t = 'order'),
      c AS (SELECT r AS a, s AS n FROM via WHERE t = 'account' AND rel = 'nation'),
      g AS (SELECT r AS n, s AS g FROM via WHERE t = 'nation' AND rel = 'region')
      SELECT o AS resource_id, 'view/account:account:' || a || '/view/manage/owner' AS path, s AS subject_id FROM o JOIN via v ON v.t = 'account' AND v.rel = 'owner' AND v.r = a
      UNION ALL SELECT o, 'view/account:account:' || a || '/view/manage/nation:nation:' || n || '/manage/manager', s FROM o JOIN c USING (a) JOIN via v ON v.t = 'nation' AND v.rel = 'manager' AND v.r = n
      UNION ALL SELECT o, 'view/account:account:' || a || '/view/manage/nation:nation:' || n || '/manage/region:region:' || g || '/manage/admin', s FROM o JOIN c USING (a) JOIN g USING (n) JOIN via v ON v.t = 'region' AND v.r = g""",
    "write_touch_delete": f"{_WITH}{_WRITTEN} SELECT {_E} FROM after",
    "delete_object": f"{_WITH} SELECT {_E} FROM edges WHERE NOT (subject_type = 'nation' AND subject_id = 4) AND NOT (resource_type = 'nation' AND resource_id = 4)",
    "dangling_halves": f"{_WITH} SELECT {_E}, CASE WHEN resource_id % 7 <> 3 THEN 'forward' ELSE 'reverse' END AS half FROM edges WHERE (resource_id % 7 <> 3) <> (subject_id % 11 <> 5)",
    "dangling_report": f"{_WITH} SELECT CASE WHEN resource_id % 7 <> 3 THEN 'forward' ELSE 'reverse' END AS half, relation, count(*) AS n FROM edges WHERE (resource_id % 7 <> 3) <> (subject_id % 11 <> 5) GROUP BY 1, 2",
    "relation_in_use": f"{_WITH} SELECT resource_type, relation, subject_type, CAST(greatest(sum(CASE WHEN resource_id % 7 <> 3 THEN 1 ELSE 0 END), sum(CASE WHEN subject_id % 11 <> 5 THEN 1 ELSE 0 END)) AS BIGINT) AS n FROM edges WHERE resource_id % 7 <> 3 OR subject_id % 11 <> 5 GROUP BY 1, 2, 3",
    "schema_delta": """WITH old(r) AS (VALUES ('region:admin:user'), ('nation:region:region'), ('nation:manager:user'), ('account:nation:nation'), ('account:owner:user'), ('order:account:account'), ('folder:owner:user'), ('folder:parent:folder')),
      new AS (SELECT r FROM old WHERE r <> 'nation:manager:user' UNION ALL SELECT 'folder:owner:region')
      SELECT 'additions' AS change, 'relation:' || r AS relation_id FROM (SELECT r FROM new EXCEPT SELECT r FROM old)
      UNION ALL SELECT 'retractions', 'relation:' || r FROM (SELECT r FROM old EXCEPT SELECT r FROM new)
      UNION ALL SELECT 'unchanged', 'relation:' || r FROM (SELECT r FROM old INTERSECT SELECT r FROM new)""",
    "snapshot_as_of": f"{_WITH} SELECT {_E} FROM edges WHERE resource_type = 'order' AND resource_id % 4 + 1 <= 3 AND (resource_id % 2 = 0 OR resource_id % 4 + 3 > 3)",
    "dependency_frontier": f"""{_WITH}, v AS (SELECT resource_type || '.' || relation AS rel, 1 + row_number() OVER (ORDER BY resource_type, relation) AS version FROM edges GROUP BY resource_type, relation),
      needs(permission, rel) AS (VALUES
        ('region.manage', 'region.admin'), ('nation.manage', 'nation.manager'), ('nation.manage', 'nation.region'), ('nation.manage', 'region.admin'), ('nation.audit', 'nation.region'), ('nation.audit', 'region.admin'),
        ('account.manage', 'account.owner'), ('account.manage', 'account.nation'), ('account.manage', 'nation.manager'), ('account.manage', 'nation.region'), ('account.manage', 'region.admin'),
        ('account.view', 'account.owner'), ('account.view', 'account.nation'), ('account.view', 'nation.manager'), ('account.view', 'nation.region'), ('account.view', 'region.admin'),
        ('order.view', 'order.account'), ('order.view', 'account.owner'), ('order.view', 'account.nation'), ('order.view', 'nation.manager'), ('order.view', 'nation.region'), ('order.view', 'region.admin'),
        ('folder.view', 'folder.owner'), ('folder.view', 'folder.parent'), ('folder.edit', 'folder.owner'), ('folder.edit', 'folder.parent'), ('folder.share', 'folder.owner'), ('folder.share', 'folder.parent'))
      SELECT permission, coalesce(max(version), 0) AS version FROM needs LEFT JOIN v USING (rel) GROUP BY permission""",
    "read_schema": """SELECT id FROM (VALUES
      ('relation:region:admin:user'), ('relation:nation:region:region'), ('relation:nation:manager:user'), ('relation:account:nation:nation'), ('relation:account:owner:user'),
      ('relation:order:account:account'), ('relation:folder:owner:user'), ('relation:folder:parent:folder'),
      ('permission:region:manage:self:relation:admin'), ('permission:nation:manage:self:relation:manager'), ('permission:nation:manage:region:permission:manage'), ('permission:nation:audit:region:relation:admin'),
      ('permission:account:manage:self:relation:owner'), ('permission:account:manage:nation:permission:manage'), ('permission:account:view:self:permission:manage'), ('permission:order:view:account:permission:view'),
      ('permission:folder:view:self:relation:owner'), ('permission:folder:view:parent:permission:view'), ('permission:folder:edit:self:relation:owner'), ('permission:folder:edit:parent:permission:share'),
      ('permission:folder:share:self:relation:owner'), ('permission:folder:share:parent:permission:edit')) x(id)""",
    "read_relationships_reverse_partial": f"{_WITH} SELECT {_E} FROM edges WHERE resource_type = 'nation'",
    "lookup_subjects_recursive": f"""{_RECURSIVE}, grow(s, r) AS (
        SELECT s, r FROM via WHERE t = 'folder' AND rel = 'owner'
        UNION SELECT grow.s, v.r FROM grow JOIN via v ON v.s = grow.r AND v.t = 'folder' AND v.rel = 'parent'
      ) SELECT r AS resource_id, s AS subject_id FROM grow WHERE r <= 20""",
    "retract_components": f"""{_WITH}, gone(type, id) AS (
        SELECT 'region', 1 UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT 'account', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
        UNION ALL SELECT 'order', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
      ) SELECT {_E} FROM edges WHERE (subject_type, subject_id) NOT IN (SELECT (type, id) FROM gone) AND (resource_type, resource_id) NOT IN (SELECT (type, id) FROM gone)""",
    "repair_halves": f"{_WITH} SELECT DISTINCT {_E} FROM edges WHERE resource_id % 7 <> 3 AND subject_id % 11 <> 5",
    "object_codec": f"{_WITH} SELECT s AS subject_id, r AS resource_id FROM via WHERE t = 'account' AND rel = 'owner'",
    "affected_by_change": f"{_WITH} SELECT r AS resource_id, s AS subject_id FROM order_view WHERE r IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 1)",
    "grants_changed": f"""{_WITH}{_WRITTEN}, now AS (SELECT DISTINCT g.s, a.resource_id AS r FROM after a JOIN account_manage g ON a.subject_id = g.r)
      SELECT s AS subject_id, r AS resource_id, 'gained' AS change FROM (SELECT s, r FROM now EXCEPT SELECT s, r FROM order_view)
      UNION ALL SELECT s, r, 'lost' FROM (SELECT s, r FROM order_view EXCEPT SELECT s, r FROM now)""",
}
