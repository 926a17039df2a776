from rowlantern.plans.oracle import ORACLE
from rowlantern.plans.queries import QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
