"""All rules; importing the package registers them, in category order of their modules."""

from pagelattice.plans.rules import eeat, head_content, links_images, native, perf_mobile, schema, site  # noqa: F401
from pagelattice.plans.rules.registry import CATEGORIES, NAMES, RULES, SCORES, Rule, dom, matches, selected

__all__ = ["CATEGORIES", "NAMES", "RULES", "SCORES", "Rule", "dom", "matches", "selected"]
