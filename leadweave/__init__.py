"""Lead tables on Spark: web pages to classified, verified, deduplicated leads."""

from leadweave.functions.rules import MailRules, NameRules, classify
from leadweave.functions.text import extract_contacts
from leadweave.operators.dedup import first_seen
from leadweave.operators.lookups import verify_domains, verify_handles
from leadweave.plans.leads import leads_from_pages, run_leads
from leadweave.sources.export import write_leads

__all__ = ["MailRules", "NameRules", "classify", "extract_contacts", "first_seen", "leads_from_pages", "run_leads",
           "verify_domains", "verify_handles", "write_leads"]
