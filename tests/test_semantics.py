from dataclasses import replace

from graphlift import ForeignKey, Source
from graphlift.operators import profile as P
from graphlift.operators import semantics as S


def rels(model):
    return {
        (r.source_entity, r.name, r.target_entity, r.cardinality, r.semantics, tuple(r.attributes))
        for r in model.relationships.collect()
    }


def test_blog_default(blog):
    m = S.enrich(blog)
    assert rels(m) == {
        ("posts", "USED_BY", "users", "N:1", "AGGREGATION", ()),
        ("posts", "POST_TAGS", "tags", "N:M", "ASSOCIATION", ("created_at",)),
    }
    assert {(r.table_name, r.entity_type) for r in m.entities.collect()} == {(t, "STRONG") for t in ("users", "posts", "tags")}
    assert S.hierarchies(m).count() == 0


def test_blog_as_coded(blog):
    m = S.enrich(blog, rule="as_coded")
    paths = {r.path for r in S.hierarchies(m).where("depth > 0").collect()}
    assert paths == {"posts > post_tags", "tags > post_tags"}
    names = {r.fk_name: r.relationship_name for r in m.fks.collect()}
    assert names == {"posts_user": "USED_BY", "pt_post": "IS_A_POSTS", "pt_tag": "IS_A_TAGS"}
    assert {r.table_name for r in m.entities.collect()} == {"users", "posts", "tags"}


def test_university(university):
    m = S.enrich(university)
    assert rels(m) == {
        ("courses", "WORKS_IN", "departments", "N:1", "ASSOCIATION", ()),
        ("professors", "WORKS_IN", "departments", "N:1", "ASSOCIATION", ()),
        ("students", "ENROLLMENTS", "courses", "N:M", "ASSOCIATION", ("enrollment_date", "grade")),
    }


def test_university_without_keys(university):
    m = S.enrich(replace(university, primary_keys={}))
    assert rels(m) == {
        ("courses", "WORKS_IN", "departments", "N:1", "ASSOCIATION", ()),
        ("professors", "WORKS_IN", "departments", "N:1", "ASSOCIATION", ()),
        ("enrollments", "HAS_STUDENTS", "students", "N:1", "ASSOCIATION", ()),
        ("enrollments", "HAS_COURSES", "courses", "N:1", "ASSOCIATION", ()),
    }
    assert m.entities.count() == 5


def test_evidence_makes_not_null(university):
    m = S.enrich(university, evidence=P.fk_profile(university))
    got = {r.fk_name: (r.not_null, r.semantics) for r in m.fks.collect()}
    assert got["course_department"] == (False, "ASSOCIATION")
    assert got["professor_department"] == (True, "AGGREGATION")


def test_inheritance_and_weak(people):
    m = S.enrich(people)
    fks = {r.fk_name: r for r in m.fks.collect()}
    assert {n for n, r in fks.items() if r.is_inheritance} == {"employee_person", "customer_person", "manager_employee"}
    assert (fks["profile_person"].cardinality, fks["profile_person"].semantics) == ("1:1", "AGGREGATION")
    assert fks["item_order"].is_weak and fks["item_order"].semantics == "COMPOSITION"
    assert fks["order_customer"].relationship_name == "PURCHASED_BY"
    entities = {r.table_name: r for r in m.entities.collect()}
    assert entities["order_item"].entity_type == "WEAK" and entities["order_item"].owner == "order"
    assert entities["person"].subclasses == ["customer", "employee"]
    assert entities["manager"].superclass == "employee"
    assert entities["order"].attributes == ["order_id"]
    assert entities["employee"].attributes == ["person_id", "name", "hired"]
    chains = {(r.root, r.member, r.depth) for r in S.hierarchies(m).collect()}
    assert chains == {("person", "person", 0), ("person", "employee", 1), ("person", "customer", 1), ("person", "manager", 2)}
    assert [(r.owner, r.weak_tables) for r in S.weak_groups(m).collect()] == [("order", ["order_item"])]
    assert [tuple(r) for r in S.hierarchy_groups(m).collect()] == [("person", ["person", "customer", "employee", "manager"])]


def test_as_coded_turns_weak_into_subclass(people):
    m = S.enrich(people, rule="as_coded")
    fks = {r.fk_name: r for r in m.fks.collect()}
    assert fks["item_order"].is_inheritance and not fks["item_order"].is_weak
    assert fks["item_order"].relationship_name == "IS_A_ORDER"
    assert S.weak_groups(m).count() == 0


def test_subclass_with_second_key_is_no_junction(people):
    dept = people.tables["person"].selectExpr("person_id AS dept_id")
    employee = people.tables["employee"].selectExpr("*", "1L AS dept_id")
    s = replace(
        people.with_tables(dept=dept, employee=employee),
        primary_keys={**people.primary_keys, "dept": ("dept_id",)},
        foreign_keys=(*people.foreign_keys, ForeignKey("employee_dept", "employee", "dept_id", "dept", "dept_id")),
    )
    strict = {r.table_name for r in S.junction_flags(s).where("is_junction").collect()}
    loose = {r.table_name for r in S.junction_flags(s, rule="as_coded").where("is_junction").collect()}
    assert strict == set() and loose == {"employee"}
    assert {r.fk_name for r in S.enriched_fks(s).where("is_inheritance").collect()} >= {"employee_person"}


def test_hierarchy_survives_a_cycle(spark, people):
    s = replace(people, foreign_keys=(*people.foreign_keys, ForeignKey("person_manager", "person", "person_id", "manager", "person_id")))
    assert S.hierarchies(S.enrich(s)).count() == 0  # no root is left, and it ends


def test_statistics(people):
    m = S.enrich(people)
    got = {r.statistic: r.value for r in S.model_statistics(m).collect()}
    assert got == {
        "total_entities": 7, "strong_entities": 6, "weak_entities": 1, "total_relationships": 6,
        "inheritance_relationships": 3, "aggregation_relationships": 2,
    }
    dist = {(r.kind, r.value): r.n for r in S.distributions(m).collect()}
    assert dist[("cardinality", "1:1")] == 4 and dist[("semantics", "COMPOSITION")] == 1


def test_junction_cardinality(blog):
    r = S.junction_cardinality(blog, ["post_tags"]).first()
    assert (r.from_fan_out, r.to_fan_out, r.cardinality) == (2, 2, "N:M")


def test_names_by_dictionary(university):
    fks = S.enriched_fks(university)
    got = {r.fk_name: r.final_name for r in S.dictionary_names(fks, {("courses", "departments"): "OFFERED_BY"}).collect()}
    assert got["course_department"] == "OFFERED_BY" and got["professor_department"] == "WORKS_IN"
    assert got["enrollment_student"] == "HAS_STUDENTS"
    by = {r.fk_name: r.final_name for r in S.dictionary_names(fks, {}, by_cardinality=True).collect()}
    assert by["enrollment_student"] == "BELONGS_TO" and by["professor_department"] == "WORKS_IN"


def test_discriminators(spark):
    df = spark.range(100).selectExpr("id", "IF(id < 60, 'full_time', 'temp') AS employee_type", "id AS other_category")
    few = {("employee_type", "full_time", "FullTime", 60), ("employee_type", "temp", "Temp", 40)}
    rows = lambda **k: {(r.column_name, r.value, r.subclass_label, r.row_count) for r in S.discriminators(Source(spark, {"t": df}), **k).collect()}
    assert rows(max_values=50) == few
    assert rows() == few | {("other_category", str(i), f"N{i}", 1) for i in range(100)}
    assert S.discriminators(Source(spark, {"t": df.select("id")})).count() == 0


def test_name_rules(spark):
    names = ["order_items", "order_Detail", "club_member", "airline", "task_assignments"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").selectExpr(S.semantics_by_name("t")).collect()
    assert [r[0] for r in rows] == ["COMPOSITION", "COMPOSITION", "AGGREGATION", None, "AGGREGATION"]
