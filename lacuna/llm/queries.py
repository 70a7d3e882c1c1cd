"""All queries of the subpackage; the modules register themselves."""

from lacuna.llm import q_part1, q_part2, q_part3, q_part4  # noqa: F401
from lacuna.llm.registry import QUERIES, SQL  # noqa: F401
