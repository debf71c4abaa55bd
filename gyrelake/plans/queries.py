"""All registered queries of this library's own operators."""

from gyrelake.plans import dynamic, field, network, observation, pairing, shapes  # noqa: F401  they register on import
from gyrelake.plans.registry import ORACLE, QUERIES  # noqa: F401
