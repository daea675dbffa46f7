"""Patterns, weights and word lists that results depend on."""

# --- Fixed values: patterns that decide what a target is ---------------------------------------------------------
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[0-9]{1,3})"
LOOSE_IPV4 = rf"(?:25[0-5]|2[0-4]\d|1\d{{2}}|[0-9]{{1,3}}\.){{3}}{OCTET}"
DOTTED_NAME = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
EMAIL_TARGET = rf"^[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}|{LOOSE_IPV4})$"
URL_TARGET = rf"^(?i)https?://(?:{DOTTED_NAME}|{LOOSE_IPV4})(?::\d{{1,5}})?(?:/[^\s]*)?$"
IPV4_TARGET = rf"^(?:{OCTET}\.){{3}}{OCTET}$"
DOMAIN_TARGET = rf"^{DOTTED_NAME}\.?$"
DOMAIN_VALID = r"^(?:\*\.)?(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,18}$"
EMAIL_VALID = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# --- Fixed values: patterns that find values in free text --------------------------------------------------------
STRICT_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
IPV4_TEXT = rf"(?:{STRICT_OCTET}\.){{3}}{STRICT_OCTET}"
DOMAIN_TEXT = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
EMAIL_TEXT = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ASN_TEXT = r"AS(\d{1,6})"
URL_TEXT = r"https?://[^\s<>\"']+"
HIT_EMAIL_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
HIT_IPV4_TEXT = r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
ASSET_EXTENSIONS = [".css", ".js", ".png", ".jpg", ".gif", ".svg", ".ico"]

# --- Fixed values: redaction -------------------------------------------------------------------------------------
SECRET_TEXT = (
    r"(?i)(api[_-]?key|token|secret|password|authorization|bearer|credential)\s*[=:]\s*\S+(?:\s+\S+)?"
)
WINDOWS_PATH = r"[A-Za-z]:\\[^\s\"']+"
UNIX_PATH = r"/(?:usr|etc|var|home|tmp|opt|proc|sys)/[^\s\"']+"
INTERNAL_IP = r"(?:10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.)[^\s\"']+"
CONNECTION_STRINGS = {r"postgresql://[^\s\"']+": "[db]", r"bolt://[^\s\"']+": "[neo4j]"}
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# --- Fixed values: networks and names that count as internal -----------------------------------------------------
INTERNAL_IPV4 = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"]
# In free text the first form that fits counts.
IPV6_TEXT = (
    r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,1}(?::[0-9a-fA-F]{1,4}){1,6}"
    r"|:(?::[0-9a-fA-F]{1,4}){1,7}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
    r"|::(?:[0-9a-fA-F]{1,4}:){0,4}[0-9a-fA-F]{1,4}"
    r"|::"
)
INTERNAL_IPV6 = r"^(?:::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"
INTERNAL_HOSTS = ["localhost", "0.0.0.0", "metadata.google.internal", "169.254.169.254"]

# --- Fixed values: words that mark a hidden registrant or a parked page ------------------------------------------
REDACTED_WORDS = ["redacted", "privacy", "whoisguard", "protected"]
HIDDEN_NAMESERVERS = ["redacted", "privacy"]
PARKED_PHRASES = [
    "domain for sale",
    "buy this domain",
    "parked",
    "coming soon",
    "under construction",
    "godaddy",
    "namecheap",
    "hover.com",
]

# --- Fixed values: trust in a source, in a way of detecting an edge, in a shared account attribute ---------------
SOURCE_RELIABILITY = {
    "dns": 0.95,
    "whois": 0.90,
    "certificate_transparency": 0.92,
    "ip_to_asn": 0.88,
    "http": 0.85,
    "github": 0.82,
    "threat_intel": 0.80,
    "search": 0.70,
}
METHOD_RELIABILITY = {
    "dns_a_record": 0.95,
    "dns_aaaa_record": 0.95,
    "dns_mx_record": 0.90,
    "dns_ns_record": 0.95,
    "dns_soa_mname": 0.90,
    "dns_soa_rname": 0.70,
    "dns_ptr_record": 0.85,
    "whois_registrant_email": 0.80,
    "whois_registrant_name": 0.70,
    "whois_registrar": 0.85,
    "whois_nameserver": 0.90,
    "ct_certificate": 0.92,
    "ct_issuer": 0.88,
    "ct_san": 0.90,
    "ip_to_asn": 0.88,
    "http_tech_detection": 0.85,
    "http_redirect": 0.80,
    "threat_intel_abuseipdb": 0.80,
    "threat_intel_urlhaus": 0.78,
    "github_profile": 0.82,
    "github_repos": 0.85,
    "co_occurrence": 0.65,
    "reddit_profile": 0.75,
    "keybase_profile": 0.78,
    "hackernews_profile": 0.76,
    "gitlab_profile": 0.80,
    "search_result": 0.70,
    "manual": 0.85,
}
DEFAULT_RELIABILITY = 0.75
ACCOUNT_WEIGHTS = {
    "email": 0.95,
    "full_name": 0.85,
    "organization": 0.70,
    "website": 0.65,
    "bio_keywords": 0.55,
    "location": 0.50,
}
MIN_ACCOUNT_SCORE = 0.45
# age in days -> factor; older than the last step, and never seen
RECENCY_STEPS = [(7, 1.0), (30, 0.95), (90, 0.90), (180, 0.85), (365, 0.80)]
RECENCY_OLDEST = 0.75
RECENCY_UNKNOWN = 0.85

# --- Fixed values: technologies named in headers and cookies -----------------------------------------------------
HEADER_TECHNOLOGIES = {
    "x-powered-by": {
        "php": "PHP",
        "asp.net": "ASP.NET",
        "express": "Express.js",
        "next.js": "Next.js",
        "rails": "Ruby on Rails",
        "django": "Django",
        "laravel": "Laravel",
    },
    "server": {
        "nginx": "Nginx",
        "apache": "Apache",
        "cloudflare": "Cloudflare",
        "microsoft-iis": "Microsoft IIS",
        "openresty": "OpenResty",
        "lighttpd": "Lighttpd",
        "caddy": "Caddy",
    },
    "x-aspnet-version": {"x-aspnet-version": "ASP.NET"},
    "x-generator": {"wordpress": "WordPress", "drupal": "Drupal", "joomla": "Joomla"},
}
COOKIE_TECHNOLOGIES = {
    "PHPSESSID": "PHP",
    "JSESSIONID": "Java",
    "connect.sid": "Express.js",
    "_rails_session": "Ruby on Rails",
    "csrftoken": "Django",
    "XSRF-TOKEN": "Laravel/Vue",
}

# --- Fixed values: which site a host belongs to ------------------------------------------------------------------
PLATFORM_HOSTS = {
    "github.com": "GitHub",
    "gitlab.com": "GitLab",
    "reddit.com": "Reddit",
    "twitter.com": "Twitter/X",
    "x.com": "Twitter/X",
    "instagram.com": "Instagram",
    "linkedin.com": "LinkedIn",
    "youtube.com": "YouTube",
    "medium.com": "Medium",
    "dev.to": "Dev.to",
    "stackoverflow.com": "StackOverflow",
    "stackexchange.com": "StackExchange",
    "twitch.tv": "Twitch",
    "t.me": "Telegram",
    "telegram.me": "Telegram",
    "keybase.io": "Keybase",
    "news.ycombinator.com": "HackerNews",
    "about.me": "About.me",
    "linktr.ee": "Linktree",
    "pinterest.com": "Pinterest",
    "tumblr.com": "Tumblr",
    "gravatar.com": "Gravatar",
    "en.gravatar.com": "Gravatar",
    "behance.net": "Behance",
    "dribbble.com": "Dribbble",
    "figma.com": "Figma",
    "notion.site": "Notion",
    "substack.com": "Substack",
    "hashnode.dev": "Hashnode",
    "producthunt.com": "ProductHunt",
    "goodreads.com": "Goodreads",
    "steamcommunity.com": "Steam",
    "open.spotify.com": "Spotify",
    "soundcloud.com": "SoundCloud",
    "flickr.com": "Flickr",
    "500px.com": "500px",
    "vimeo.com": "Vimeo",
    "npmjs.com": "npm",
    "crates.io": "Crates.io",
    "dockerhub.com": "DockerHub",
    "hub.docker.com": "DockerHub",
    "bitbucket.org": "Bitbucket",
    "codepen.io": "CodePen",
    "jsfiddle.net": "JSFiddle",
    "replit.com": "Replit",
    "leetcode.com": "LeetCode",
    "hackerrank.com": "HackerRank",
    "codewars.com": "Codewars",
    "kaggle.com": "Kaggle",
    "researchgate.net": "ResearchGate",
    "academia.edu": "Academia",
    "orcid.org": "ORCID",
    "scholar.google.com": "Google Scholar",
    "zhihu.com": "Zhihu",
    "quora.com": "Quora",
}
PROFESSIONAL_PLATFORMS = ["LinkedIn", "ResearchGate", "Academia"]
PERSONAL_WEBSITE = "Personal Website"

# --- Fixed values: what to collect for a target type, and for an entity type -------------------------------------
TARGET_ACTIONS = {
    "domain": ["collect_dns", "collect_whois", "collect_ct", "collect_http", "collect_search"],
    "ip": ["collect_dns", "collect_ip_asn", "collect_threat_intel", "collect_search"],
    "url": ["collect_dns", "collect_http", "collect_search"],
    "email": ["collect_github", "collect_dns", "collect_whois", "collect_http"],
    "username": ["collect_search"],
    "organization": ["collect_github", "collect_dns", "collect_search", "collect_http", "collect_whois"],
    "unknown": ["collect_dns", "collect_http", "collect_search"],
}
ENTITY_ACTIONS = {
    "Domain": "collect_dns",
    "Subdomain": "collect_dns",
    "IP": "collect_ip_asn",
    "ASN": "collect_ip_asn",
    "Email": "collect_whois",
    "URL": "collect_http",
    "Repository": "collect_github",
    "Username": "collect_github",
    "ThreatIndicator": "collect_threat_intel",
    "Certificate": "collect_ct",
    "Technology": "collect_http",
}
DEPTH_ROUNDS = {"shallow": 1, "standard": 3, "deep": 6}
CALLS_PER_ACTION_AND_ROUND = 20

# --- Fixed values: STIX 2.1 names --------------------------------------------------------------------------------
STIX_NAMESPACE = "d895aa52-df85-4cfb-8306-cf80b54a2c3e"
STIX_OBJECT_TYPES = {
    "Domain": "domain-name",
    "IP": "ipv4-addr",
    "Email": "email-addr",
    "URL": "url",
    "Organization": "identity",
    "Person": "identity",
    "Username": "identity",
    "Repository": "software",
    "ASN": "autonomous-system",
    "ThreatIndicator": "indicator",
    "Certificate": "x509-certificate",
    "Technology": "software",
    "Subdomain": "domain-name",
}
STIX_VERBS = {
    "hosted_on": "communicates-with",
    "uses_nameserver": "resolves-to",
    "sends_mail_via": "communicates-with",
    "registered_by": "attributed-to",
    "has_subdomain": "has",
    "belongs_to_asn": "located-at",
    "associated_with_email": "attributed-to",
    "associated_with_threat": "indicates",
    "co_occurs_with": "related-to",
    "same_person": "related-to",
}

# --- Fixed values: handle variants and personal domains ----------------------------------------------------------
HANDLE_SEPARATORS = ["", ".", "-", "_"]
HANDLE_PREFIXES = ["the", "real"]
HANDLE_SUFFIXES = ["0", "1", "2"]
LEET_DIGITS = {
    "a": "4",
    "e": "3",
    "i": "1",
    "o": "0",
    "s": "5",
    "t": "7",
    "l": "1",
    "b": "8",
    "g": "9",
    "z": "2",
}
PERSONAL_TLDS = [".dev", ".io", ".com", ".me", ".xyz", ".site", ".app"]

# --- Fixed values: company endings ignored when names are compared ------------------------------------------------
COMPANY_ENDINGS = [" inc", " llc", " ltd", " corp", " co", " company", " corporation"]

# --- Fixed values: profile rules for stored search hits ----------------------------------------------------------
PROFILE_RULES = [
    {
        "platform_key": "x_twitter",
        "patterns": [r"x\.com/[a-zA-Z0-9_]+$", r"twitter\.com/[a-zA-Z0-9_]+$"],
        "negatives": ["this account doesn't exist", "account suspended", "page doesn't exist"],
        "base_confidence": 0.55,
    },
    {
        "platform_key": "linkedin",
        "patterns": [r"linkedin\.com/in/[a-zA-Z0-9_-]+$"],
        "negatives": ["page not found", "profile not found"],
        "base_confidence": 0.50,
    },
    {
        "platform_key": "instagram",
        "patterns": [r"instagram\.com/[a-zA-Z0-9_.]+$"],
        "negatives": ["sorry, this page isn't available", "the link you followed may be broken"],
        "base_confidence": 0.50,
    },
    {
        "platform_key": "tiktok",
        "patterns": [r"tiktok\.com/@[a-zA-Z0-9_.]+$"],
        "negatives": ["couldn't find this account", "page not available"],
        "base_confidence": 0.50,
    },
]

# --- Fixed values: characters stripped from the ends of a value --------------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
