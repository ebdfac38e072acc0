"""All queries of this subpackage; importing it registers them."""

from veil.llm import chat, decontamination, language, licenses, line_dedup, merkle, packing, secrets, simhash, spelling, topk, toxicity, warc  # noqa: F401
from veil.llm.common import ORACLES, QUERIES  # noqa: F401
