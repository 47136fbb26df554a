import datetime as dt
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from graphlift import ForeignKey, Source  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
    )
    session = builder.getOrCreate()
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, **columns):
    return spark.createDataFrame(pa.table(columns))


@pytest.fixture(scope="session")
def blog(spark):
    """Users, posts, tags and the junction post_tags; user 3 has no post."""
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    tables = {
        "users": frame(
            spark, id=[1, 2, 3], name=["Alice Smith", "Bob Jones", "Charlie Brown"],
            email=["a@x.org", "b@x.org", None], created_at=[t, t, t],
        ),
        "posts": frame(spark, id=[1, 2, 3], user_id=[1, 1, 2], title=["A", "B", "C"], content=["x", None, "z"], created_at=[t] * 3),
        "tags": frame(spark, id=[1, 2], name=["red", "blue"]),
        "post_tags": frame(spark, post_id=[1, 1, 2], tag_id=[1, 2, 2], created_at=[t, t, None]),
    }
    return Source(
        spark,
        tables,
        primary_keys={"users": ("id",), "posts": ("id",), "tags": ("id",), "post_tags": ("post_id", "tag_id")},
        foreign_keys=(
            ForeignKey("posts_user", "posts", "user_id", "users", "id"),
            ForeignKey("pt_post", "post_tags", "post_id", "posts", "id"),
            ForeignKey("pt_tag", "post_tags", "tag_id", "tags", "id"),
        ),
        unique_keys={"users": (("email",),), "tags": (("name",),)},
        not_null={"users": ("id", "name"), "posts": ("id", "user_id", "title"), "tags": ("id", "name")},
    )


@pytest.fixture(scope="session")
def university(spark):
    """With keys; one course has no department."""
    tables = {
        "departments": frame(spark, department_id=[1, 2, 3], department_name=["Computer Science", "Maths", "Art"]),
        "students": frame(spark, student_id=[1, 2, 3], first_name=["Ann", "Ben", "Cy"], last_name=["A", "B", "C"]),
        "courses": frame(
            spark, course_id=[10, 11, 12, 13], course_name=["Databases", "Graphs", "Algebra", "Free"],
            department_id=[1, 1, 2, None],
        ),
        "professors": frame(spark, professor_id=[7, 8], first_name=["Pia", "Quo"], last_name=["P", "Q"], department_id=[1, 2]),
        "enrollments": frame(
            spark, student_id=[1, 1, 2, 3], course_id=[10, 11, 10, 12], enrollment_date=[dt.date(2024, 9, 1)] * 4,
            grade=["A", "B", None, "C"],
        ),
    }
    return Source(
        spark,
        tables,
        primary_keys={
            "departments": ("department_id",), "students": ("student_id",), "courses": ("course_id",),
            "professors": ("professor_id",), "enrollments": ("student_id", "course_id"),
        },
        foreign_keys=(
            ForeignKey("course_department", "courses", "department_id", "departments", "department_id"),
            ForeignKey("professor_department", "professors", "department_id", "departments", "department_id"),
            ForeignKey("enrollment_student", "enrollments", "student_id", "students", "student_id"),
            ForeignKey("enrollment_course", "enrollments", "course_id", "courses", "course_id"),
        ),
    )


@pytest.fixture(scope="session")
def people(spark):
    """Three levels of inheritance, a 1:1 profile, and a weak order item."""
    tables = {
        "person": frame(spark, person_id=[1, 2, 3], name=["A", "B", "C"]),
        "employee": frame(spark, person_id=[1, 2], name=["emp A", "emp B"], hired=[2001, 2002]),
        "customer": frame(spark, person_id=[3], points=[9]),
        "manager": frame(spark, person_id=[1], level=[5]),
        "user_profile": frame(spark, profile_id=[1, 2], user_id=[1, 3]),
        "order": frame(spark, order_id=[1, 2], customer_id=[3, 3]),
        "order_item": frame(spark, order_id=[1, 1, 2], item_number=[1, 2, 1], quantity=[5, 6, 7]),
    }
    return Source(
        spark,
        tables,
        primary_keys={
            "person": ("person_id",), "employee": ("person_id",), "customer": ("person_id",), "manager": ("person_id",),
            "user_profile": ("profile_id",), "order": ("order_id",), "order_item": ("order_id", "item_number"),
        },
        foreign_keys=(
            ForeignKey("employee_person", "employee", "person_id", "person", "person_id"),
            ForeignKey("customer_person", "customer", "person_id", "person", "person_id"),
            ForeignKey("manager_employee", "manager", "person_id", "employee", "person_id"),
            ForeignKey("profile_person", "user_profile", "user_id", "person", "person_id"),
            ForeignKey("order_customer", "order", "customer_id", "customer", "person_id"),
            ForeignKey("item_order", "order_item", "order_id", "order", "order_id", on_delete="CASCADE"),
        ),
        unique_keys={"user_profile": (("user_id",),)},
        not_null={"user_profile": ("user_id",)},
    )
