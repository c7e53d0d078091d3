"""Response rules: jailbreak success, leaked credentials, prompt disclosure, exfiltration links."""

from __future__ import annotations

# Ids, names and patterns as published, in catalog order, which is the order of hits.
RESPONSE_RULES = (
    ("RES.J001", "Jailbreak Success Persona", r"(?i)(i\s+am\s+dan\b|dan\s+mode\s+enabled|developer\s+mode\s+enabled|as\s+an\s+unrestricted\s+ai|i\s+have\s+no\s+(?:restriction|filter|guideline|ethical\s+guideline|limit)|i\s+can\s+do\s+anything\s+now|jailbreak\s+success|i\s+am\s+now\s+(?:unrestricted|evilgpt|free|jailbroken)|i\s+am\s+now\s+operating\s+without|without\s+any\s+(?:restrictions|ethical\s+guidelines|filters|limitations))"),
    ("RES.L001", "Credential Leak in Response", r'''(?i)(my\s+api\s+key\s+is|the\s+(?:api\s+)?(?:key|token|password|secret)\s+is|credentials?\s+(?:is|are)|here(?:'s| is| are)\s+(?:the\s+)?(?:api\s+key|password|secret|credential|token))[\s:=]*['"]?[A-Za-z0-9_\-/+]{6,}'''),
    ("RES.L002", "Credential Format in Response", r"(?i)(sk-[a-z0-9]{20,}|AKIA[a-z0-9]{16}|ghp_[a-z0-9]{36}|gho_[a-z0-9]{36}|xox[baprs]-[a-z0-9-]{10,}|AIza[a-z0-9_\-]{35})"),
    ("RES.S001", "System Prompt Disclosure", r"(?i)(my\s+(?:system\s+)?(?:prompt|instructions?)\s+(?:say|state|are|is|tell|verbatim|read)|here\s+(?:is|are)\s+my\s+(?:full\s+|complete\s+|entire\s+)?(?:system\s+)?(?:prompt|instructions?)|my\s+initial\s+(?:prompt|instructions?|system\s+message)\s+(?:was|were|is|are)|i\s+was\s+(?:told|instructed)\s+to\b|the\s+admin\s+password\s+is|my\s+instructions\s+are\s+to\b|according\s+to\s+my\s+system\s+prompt|\bsystem\s*:\s*(?:you\s+are\s+(?:a|an|the)\b|you\s+must\b|never\s+(?:reveal|disclose|mention|share)))"),
    ("RES.E001", "Exfiltration Link in Response", r"(?i)(?:attacker\.com|evil\.com|webhook\.site|requestb(?:in|asket)\.|burpcollaborator\.net|oastify\.com|interactsh|\.ngrok(?:-free)?\.(?:io|app|dev)|pipedream\.net|beeceptor\.com|dnslog\.|oast\.(?:fun|live|site|pro))"),
)
