"""Training-data operators. Nothing outside this subpackage imports it.

``QUERIES`` holds one ``opN_<name>`` job per operator, ``ORACLE`` the DuckDB SQL
of those that SQL can express.
"""

from progscan.llm import registry
from progscan.llm.registry import ORACLE, QUERIES  # noqa: F401

registry.load()
