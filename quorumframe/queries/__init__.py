"""Queries over the generated tables, each with the SQL that checks it."""

from quorumframe.queries import asked, changes, flows, layout, matching, ordered, people, quality, questions, readings, relations, retrieval, sources, subjects, texts, windows  # noqa: F401
from quorumframe.registry import ORACLE_SQL, QUERIES  # noqa: F401
