"""The detectors: ordered rules with their patterns and the literals that a line must hold for a rule to match."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    ord: int
    name: str
    type: str
    pattern: str
    #: A line without all of one of these can't match; a rule that ignores case has them in lower case.
    guards: tuple[str, ...]

    @property
    def effective(self) -> bool:
        """A rule whose pattern has no group yields no finding."""
        return "(" in self.pattern.replace(r"\(", "").replace("(?", "")

    @property
    def folded(self) -> bool:
        return self.pattern.startswith("(?i)")

    @property
    def java(self) -> str:
        """The same matches in Java's dialect: LF alone ends a line for the dot, case folds beyond ASCII, and white space is ASCII without VT."""
        p = self.pattern.replace(r"\s", r"\t\n\f\r ")
        if self.name == "Relative URL":  # possessive: a repeated group would recurse once for each segment
            p = p.replace("]+", "]++").replace(")*", ")*+")
        return "(?d)" + p.replace("(?i)", "(?iu)")


SECRET, CONFIG, ENDPOINT, GENERIC = "secret", "config", "endpoint", "generic"
TYPES = (SECRET, CONFIG, ENDPOINT, GENERIC)

# Rule names, types and patterns in the order that decides which finding comes first.
# A backslash before "-_" in a class is itself the start of the range from backslash to underscore.
_RULES = [
    ("AWS Access Key ID", SECRET, r"((?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16})", ("A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA")),
    ("AWS Secret Key", SECRET, r"""(?i)aws_?secret_?access_?key[\s:=]+["']?([A-Za-z0-9/+=]{40})["']?""", ("access",)),
    ("Amazon MWS Auth Token", SECRET, r"(amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", ("amzn.mws.",)),
    ("AWS AppSync GraphQL Key", SECRET, r"(da2-[a-z0-9]{26})", ("da2-",)),
    ("Google API Key", SECRET, r"(AIza[0-9A-Za-z\\-_]{35})", ("AIza",)),
    ("Google OAuth", SECRET, r"""(?i)client_?secret[\s:=]+["']?([0-9a-zA-Z\-_]{24})["']?""", ("client",)),
    ("Google Service Account", SECRET, r'("type": "service_account")', ("service_account",)),
    ("Facebook Access Token", SECRET, r"(EAACEdEose0cBA[0-9A-Za-z]+)", ("EAACEdEose0cBA",)),
    ("Facebook OAuth", SECRET, r"""(?i)facebook.{0,20}['|"][0-9a-f]{32}['|"]""", ("facebook",)),
    ("Stripe API Key", SECRET, r"(sk_live_[0-9a-zA-Z]{24,})", ("sk_live_",)),
    ("Stripe Publishable Key", SECRET, r"(pk_live_[0-9a-zA-Z]{24,})", ("pk_live_",)),
    ("Stripe Restricted API Key", SECRET, r"(rk_live_[0-9a-zA-Z]{24,})", ("rk_live_",)),
    ("GitHub Personal Access Token", SECRET, r"(ghp_[0-9a-zA-Z]{36})", ("ghp_",)),
    ("GitHub OAuth Token", SECRET, r"(gho_[0-9a-zA-Z]{36})", ("gho_",)),
    ("GitHub Legacy Token", SECRET, r"""(?i)github.{0,20}['|"][0-9a-zA-Z]{35,40}['|"]""", ("github",)),
    ("GitHub Auth Creds", SECRET, r"(https://[a-zA-Z0-9]{40}@github\.com)", ("@github.com",)),
    ("Heroku API Key", SECRET, r"(?i)heroku.{0,20}[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}", ("heroku",)),
    ("MailChimp API Key", SECRET, r"([0-9a-f]{32}-us[0-9]{1,2})", ("-us",)),
    ("PayPal Braintree Access Token", SECRET, r"(access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32})", ("access_token$",)),
    ("Picatic API Key", SECRET, r"(sk_live_[0-9a-z]{32})", ("sk_live_",)),
    ("Square Access Token", SECRET, r"(sq0atp-[0-9A-Za-z\\-_]{22})", ("sq0atp-",)),
    ("Square OAuth Secret", SECRET, r"(sq0csp-[0-9A-Za-z\\-_]{43})", ("sq0csp-",)),
    ("Telegram Bot API Key", SECRET, r"([0-9]+:AA[0-9A-Za-z\\-_]{33})", (":AA",)),
    ("JWT Token", SECRET, r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", ("eyJ",)),
    ("Generic API Key", SECRET, r"""(?i)api[_-]?key[\s:=]+["']([A-Za-z0-9\-_]{20,})["']""", ("api",)),
    ("Generic Token", SECRET, r"""(?i)(?:token|auth)[\s:=]+["']([A-Za-z0-9\-_\.]{20,})["']""", ("token", "auth")),
    ("Generic Secret", SECRET, r"""(?i)secret[\s:=]+["']([A-Za-z0-9\-_]{20,})["']""", ("secret",)),
    ("Generic Password", SECRET, r"""(?i)password[\s:=]+["']([^"'\s]{8,})["']""", ("password",)),
    ("Password in URL", SECRET, r"""([a-zA-Z]{3,10}://[^/\s:@]{3,20}:[^/\s:@]{3,20}@.{1,100}["'\s])""", ("://",)),
    ("PostgreSQL Connection", CONFIG, r"""(postgres(?:ql)?://[^\s'"]+)""", ("postgres",)),
    ("MySQL Connection", CONFIG, r"""(mysql://[^\s'"]+)""", ("mysql://",)),
    ("MongoDB Connection", CONFIG, r"""(mongodb(?:\+srv)?://[^\s'"]+)""", ("mongodb",)),
    ("Redis Connection", CONFIG, r"""(redis://[^\s'"]+)""", ("redis://",)),
    ("Relative URL", ENDPOINT, r"""["'](/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+(?:/[a-zA-Z0-9_.-]+)*)["']""", ('"/', "'/")),
    ("HTTP URL", ENDPOINT, r"""(https?://[^\s"'<>]+)""", ("://",)),
    ("WebSocket URL", ENDPOINT, r"""(wss?://[^\s"'<>]+)""", ("://",)),
    ("API Endpoint", ENDPOINT, r"""["'](/api/[^\s"']+)["']""", ("/api/",)),
    ("GraphQL Endpoint", ENDPOINT, r"""["']([^"']*graphql[^"']*)["']""", ("graphql",)),
    ("Admin Endpoint", ENDPOINT, r"""["'](/(?:admin|internal|private)/[^\s"']+)["']""", ("/admin/", "/internal/", "/private/")),
    ("Slack Webhook", SECRET, r"(https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+)", ("hooks.slack.com",)),
    ("Slack Token", SECRET, r"(xox[pborsa]-[0-9]{12}-[0-9]{12}-[0-9]{12}-[a-z0-9]{32})", ("xox",)),
    ("Twilio API Key", SECRET, r"(SK[0-9a-fA-F]{32})", ("SK",)),
    ("SendGrid API Key", SECRET, r"(SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43})", ("SG.",)),
    ("MailGun API Key", SECRET, r"(key-[0-9a-zA-Z]{32})", ("key-",)),
    ("SSH Private Key", SECRET, r"(-----BEGIN (?:RSA|DSA|EC|OPENSSH|PGP) PRIVATE KEY(?: BLOCK)?-----)", ("-----BEGIN",)),
]

RULES = tuple(Rule(i, *r) for i, r in enumerate(_RULES, 1))
EFFECTIVE = tuple(r for r in RULES if r.effective)
#: Order, name and type of entropy findings, behind all rules.
ENTROPY_ORD, ENTROPY_NAME = len(RULES) + 1, "High Entropy String"
