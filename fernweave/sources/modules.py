"""Source files and documents written from the star schema, as a file tree that extraction and resolution can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .star import load

SUPPLIER = '''"""Supplier %s."""
from .base import Nation
from n0.base import helper
import os

LIMIT = 3

class Supplier%d(Nation):
    """A supplier."""
    def load(self):
        return self.total()

    def total(self):
        return compute(%d)

def compute(x):
    return helper(x)
'''
BASE = '''class Nation:
    def name(self):
        return "%s"

def helper(x):
    return x
'''
DOCUMENT = """# %s

First line of %s.
Second line.

## Orders
See `compute` and src/n%d/base.py here, `true` too.

Notes *here*
------------
Again `Nation.name` and `compute`.
## Orders
End."""


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a package a nation with a base module, a module a supplier, and a module a region that is no Python."""
    nations, suppliers = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    base = nations.select(F.format_string("src/n%d/base.py", "n_nationkey").alias("path"), F.format_string(BASE, "n_name").alias("text"))
    init = nations.select(F.format_string("src/n%d/__init__.py", "n_nationkey"), F.lit("from .base import Nation, helper\n"))
    own = suppliers.select(F.format_string("src/n%d/supplier_%d.py", "s_nationkey", "s_suppkey"), F.format_string(SUPPLIER, "s_name", "s_suppkey", "s_suppkey"))
    broken = load(spark, sf_dir, "region").select(F.format_string("src/r%d/broken.py", "r_regionkey"), F.lit("def broken(:\n"))
    return base.unionAll(init).unionAll(own).unionAll(broken)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a Markdown document a customer."""
    customers = load(spark, sf_dir, "customer")
    return customers.select(F.format_string("docs/c%d.md", "c_custkey").alias("path"), F.format_string(DOCUMENT, "c_name", "c_name", "c_nationkey").alias("text"))
