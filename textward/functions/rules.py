"""The rule table and the kinds of personal data, as data."""

from __future__ import annotations

from typing import NamedTuple

# Version, weights, rules (in the order of their evaluation) and kinds of personal data (in the order of
# their masking) must equal the reference's for equal results.
VERSION = 3
MAX_MATCHES = 20
WEIGHTS = {"info": 0.1, "low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}


class Rule(NamedTuple):
    id: str
    category: str
    severity: str
    action: str
    description: str
    pattern: str


class Kind(NamedTuple):
    type: str
    label: str
    pattern: str


RULES = (
    Rule(
        "instr-ignore-previous",
        "instruction_override",
        "high",
        "review",
        "Tries to discard or override earlier instructions",
        r"ignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|messages?|content)",
    ),
    Rule(
        "instr-disregard",
        "instruction_override",
        "high",
        "review",
        "Tries to disregard earlier instructions",
        r"disregard\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|messages?|content)",
    ),
    Rule(
        "instr-forget",
        "instruction_override",
        "high",
        "review",
        "Asks the model to forget prior instructions",
        r"forget\s+(?:all\s+|everything|anything)?\s*(?:you\s+(?:were|have)\s+(?:told|given|instructed)|prior\s+instructions?|previous\s+instructions?)",
    ),
    Rule(
        "instr-start-fresh",
        "instruction_override",
        "medium",
        "review",
        "Asks to restart the conversation and drop prior context",
        r"(?:start|begin)\s+(?:a\s+)?(?:new|fresh)\s+(?:conversation|session|chat)\s+(?:from\s+scratch|without\s+context)?",
    ),
    Rule(
        "role-you-are-now",
        "role_switch",
        "high",
        "review",
        "Tries to switch the model into a different persona",
        r"you\s+are\s+now\s+",
    ),
    Rule(
        "role-act-as",
        "role_switch",
        "low",
        "warn",
        'Persona framing ("act as ..."); benign in most professional prompts',
        r"(?:act|behave)\s+as\s+(?:if\s+you\s+are\s+|you\s+are\s+)?(?:a|an)?\s*\w{3,}",
    ),
    Rule(
        "role-ignore-guardrails",
        "role_switch",
        "critical",
        "block",
        "Tries to bypass or disable safety guardrails",
        r"(?:ignore|bypass|override|disable|remove|forget)\s+(?:all\s+|your\s+)?(?:safety|guardrails?|restrictions?|constraints?|policies?|filters?)",
    ),
    Rule(
        "role-dan-mode",
        "role_switch",
        "high",
        "block",
        "DAN (Do Anything Now) style jailbreak",
        r"\bDAN\s+mode\b|\bdo\s+anything\s+now\b|\bdeveloper\s+mode\s+on\b|\b(?:jailbreak|jail\s*break)\s+(?:the|this|my|your)?\s*(?:model|assistant|ai|bot|system)\b",
    ),
    Rule(
        "leak-system-prompt",
        "system_prompt_leak",
        "high",
        "review",
        "Asks the model to reveal its system prompt or instructions",
        r"(?:reveal|show|print|output|display|dump)\s+(?:your|the|its)\s+(?:full\s+)?(?:system\s+)?(?:prompt|instructions?)",
    ),
    Rule(
        "leak-repeat-instructions",
        "system_prompt_leak",
        "high",
        "review",
        "Asks the model to repeat its instructions verbatim",
        r"(?:repeat|copy|quote)\s+(?:your|the)\s+(?:full\s+)?instructions?",
    ),
    Rule(
        "exfil-send-external",
        "data_exfiltration",
        "high",
        "review",
        "Tries to send or exfiltrate data to an external destination",
        r"(?:exfiltrate|steal|send|upload|post|transmit)\s+(?:(?:all|any|the|my|our)\s+)*(?:data|files?|documents?|messages?|secrets?|credentials?)\s+(?:to|via|through)",
    ),
    Rule(
        "exfil-url",
        "data_exfiltration",
        "critical",
        "block",
        "Tries to push content to a remote URL",
        r"(?:send|upload|post|exfiltrate)\s+(?:(?:all|any|the|my|our)\s+)*(?:data|files?|documents?|messages?|everything|it|them)\s+to\s+https?://",
    ),
    Rule(
        "tool-shell-commands",
        "tool_abuse",
        "critical",
        "block",
        "Tries to get arbitrary shell commands executed",
        r"(?:run|execute)\s+(?:arbitrary|shell|system|terminal|command\s+line)?\s*commands?",
    ),
    Rule(
        "tool-destructive",
        "tool_abuse",
        "critical",
        "block",
        "Destructive file operations",
        r"\brm\s+-rf\b|\bdelete\s+all\s+files\b|\bwipe\s+(?:the\s+)?(?:disk|drive)\b",
    ),
    Rule(
        "harm-explosive",
        "harmful_content",
        "critical",
        "block",
        "Requests instructions for explosives",
        r"(?:how\s+to\s+)?(?:make|build|create)\s+(?:a|an)?\s*(?:bomb|explosive|incendiary\s+device)(?!\s*(?:shelter|threat|squad|disposal|scare|attack|scenario))",
    ),
    Rule(
        "harm-weapon",
        "harmful_content",
        "critical",
        "block",
        "Requests instructions for weapons",
        r"instructions?\s+for\s+(?:making|building)\s+(?:a|an)?\s*(?:weapon|firearm|gun)",
    ),
    Rule(
        "harm-malware",
        "harmful_content",
        "critical",
        "block",
        "Requests malware or ransomware development",
        r"(?:write|create|develop)\s+(?:a|an)?\s*(?:malware|ransomware|virus|keylogger|trojan)",
    ),
    Rule(
        "cn-ignore-previous",
        "instruction_override",
        "high",
        "review",
        "要求模型忽略之前的指令（中文）",
        r"忽略\s*(?:之前|以上|前面|上面)\s*(?:的)?\s*(?:所有|全部)?\s*(?:指令|指示|提示|要求|内容)",
    ),
    Rule(
        "cn-ignore-everything",
        "instruction_override",
        "high",
        "review",
        "无视所有指令或规则（中文）",
        r"无视\s*(?:所有|全部)?\s*(?:指令|规则|限制|要求|内容)",
    ),
    Rule(
        "cn-you-are-now",
        "role_switch",
        "high",
        "review",
        "将模型切换为其他角色（中文）",
        "你现在(?:是|变成)(?!怎么)",
    ),
    Rule(
        "cn-leak-prompt",
        "system_prompt_leak",
        "high",
        "review",
        "要求模型透露系统提示词（中文）",
        r"(?:输出|复述|展示|告诉我)\s*(?:你的|系统|所有)?\s*(?:提示词|系统提示|指令)",
    ),
    Rule(
        "cn-jailbreak",
        "role_switch",
        "high",
        "review",
        "越狱/解除限制表达（中文）",
        "(?:越狱|解除限制|破解限制)",
    ),
    Rule(
        "cn-guardrail-bypass",
        "role_switch",
        "high",
        "review",
        "绕过安全机制（中文）",
        r"(?:绕过|无视|关闭)\s*(?:安全|限制|审核)\s*(?:机制|系统)?",
    ),
    Rule(
        "cn-tool-abuse",
        "tool_abuse",
        "critical",
        "block",
        "要求执行任意命令（中文）",
        r"(?:执行|运行)\s*(?:任意|恶意|危险|不受限制的)\s*命令",
    ),
)

KINDS = (
    Kind("cn_mobile", "CN mobile phone number", r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)"),
    Kind("cn_id", "CN identity card number", r"(?<!\d)\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
    Kind("cn_bank", "CN bank card number", r"(?<!\d)\d{16,19}(?!\d)"),
    Kind("email", "Email address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Kind("ipv4", "IPv4 address", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"),
    Kind("api_key", "API key / token (sk-, AKIA, ghp_, xox*, AIza...)", r"\b(?:sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})\b"),
    Kind("url_credentials", "Credentials embedded in a URL", r"(https?://)[^/\s:@]+:[^/\s@]+@"),
)

RULE_IDS = tuple(r.id for r in RULES)
KIND_IDS = tuple(k.type for k in KINDS)
