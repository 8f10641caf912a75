"""Fixed values that URL rules are made of. They decide results, so they are stated plainly and together."""

from __future__ import annotations

# --- fixed values: site families and their hosts -------------------------------------------------------------------
FAMILY_ROUTES = "ajcass"  # sites whose pages are hash routes of one application
FAMILY_PORTAL = "cbpt_cnki"  # sites with a classic and a portal part
FAMILY_GENERIC = "generic"
ROUTES_DOMAIN = "ajcass.com"
ROUTES_MAIN_HOST = "zgncjj.ajcass.com"
PORTAL_SUFFIX = ".cbpt.cnki.net"
SHARED_API_HOST = "uniapp.boyuancb.com"
SHARED_API_PREFIX = "https://uniapp.boyuancb.com/api/SiteWebApi/"
SITE_CONTENT_API = "https://api.ajcass.com/api/JournalInfoApi/GetSiteContentPageList"
ISSUE_SEARCH_API = "https://api.ajcass.com/api/IssueContentApi/GetIssueNormalSearch"
ISSUE_SIMPLE_API = "https://api.ajcass.com/api/IssueContentApi/GetIssueSimpleSearch"
POLICY_VERSION = 5

# --- fixed values: routes of the first family ----------------------------------------------------------------------
ROUTE_PREFIXES = ["/index", "/detail", "/search", "/issue", "/issueDetail", "/enIndex", "/enIssue"]
SCRIPT_ROUTES = ["/index", "/detail", "/search", "/issueDetail", "/issue", "/enIndex", "/enIssue"]
ROUTE_PARAMETERS = {
    "/detail": ["channelId", "id", "title", "parentId", "type"],
    "/index": ["id", "title", "type"],
    "/search": ["author", "authors", "channelId", "curr", "issue", "keyword", "keywords", "page", "title", "unit", "year"],
    "/issue": ["id", "issue", "title", "year"],
    "/issueDetail": ["contentId", "issue", "title", "year"],
    "/enIndex": ["id", "title", "type"],
    "/enIssue": ["contentId", "title"],
}

# --- fixed values: names that decide whether a URL is followed -----------------------------------------------------
TRACKING_KEYS = ["from", "source", "spm", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
NON_HTML_SUFFIXES = [
    "7z", "avi", "bmp", "csv", "css", "doc", "docx", "eot", "epub", "gif", "gz", "ico", "jpeg", "jpg", "js", "json", "m4a", "m4v", "md",
    "mov", "mp3", "mp4", "ods", "odt", "pdf", "png", "ppt", "pptx", "rar", "rtf", "swf", "svg", "tar", "tgz", "ttf", "ts", "txt", "wav",
    "webm", "webp", "woff", "woff2", "xls", "xlsx", "xml", "zip",
]
BLOCKED_SUFFIXES = [
    "bmp", "csv", "doc", "docx", "epub", "eot", "gif", "ico", "jpeg", "jpg", "m4s", "mp3", "mp4", "pdf", "png", "ppt", "pptx", "rar", "svg",
    "tar", "ttf", "wav", "webm", "webp", "woff", "woff2", "xls", "xlsx", "zip",
]
BLOCKED_RESOURCE_TYPES = ["image", "media", "font", "ping"]
STATIC_PREFIXES = ["dist", "src", "assets", "static", "_nuxt", "js", "css", "img", "image", "images", "fonts", "media", "scripts"]
UNSAFE_SEGMENTS = ["delete", "del", "exit", "logoff", "logout", "quit", "remove", "signoff", "signout"]
UNSAFE_PAIRS = [
    ("action", "delete"), ("action", "del"), ("action", "logout"), ("action", "logoff"), ("action", "quit"), ("action", "remove"),
    ("do", "logout"), ("method", "delete"), ("method", "logout"), ("op", "delete"), ("op", "logout"),
]
DESTRUCTIVE_KEYS = ["logout", "logoff", "signout", "signoff", "delete", "remove"]
HARMLESS_VALUES = ["", "0", "false", "no"]
HTML_TAGS = [
    "a", "b", "br", "dd", "div", "dl", "dt", "em", "font", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "ol", "p", "small",
    "span", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tr", "u", "ul",
]
ENDPOINT_FILENAMES = [
    "articledownloadcontrol.do", "existscnctstinarticle.do", "exportcitation.do", "downloadissueinfo.aspx", "getdianjishu.jsp",
    "getdianjirichhtmlshu.jsp", "getchinesdownloadinfobyenglishpaper", "getchineseenglishquotepaperformat", "gotocnkinodeurl",
    "getxiazaishu.jsp", "kbdownload.aspx", "listprepaperornextpaper", "paperpage_list", "recommendbydocid", "showalertinfo.do",
    "wkdownfilebylink.aspx", "waf_slider_captcha", "waf_slider_verify.html",
    "404.htm", "404.html", "404.aspx", "500.htm", "500.html", "500.aspx",
]
LOW_PRIORITY_FILENAMES = ["component.do", "css.aspx", "login.aspx", "register_note.aspx"]
LOW_PRIORITY_SEGMENTS = ["auditor", "login", "register", "signin", "signup"]
UPLOAD_PREFIX = "/uploadfile"

# --- fixed values: what kinds of pages there are, and how they rank ------------------------------------------------
PORTAL_API_PARTS = ["/portal/journal/portal/journal/api/", "/portal/journal/portal/common/api/"]
PORTAL_LIST_PARTS = [
    "/portal/journal/portal/client/guokan_list", "/portal/journal/portal/client/paper_list/", "/portal/journal/portal/client/paperrank_list/",
    "/portal/journal/portal/client/shoufa_list", "/portal/journal/portal/client/list/", "/portal/journal/portal/client/download/",
    "/portal/journal/portal/client/linkpost/",
]
NAVIGATION_PARAMETERS = ["colType", "tp", "yt", "st", "navigationContentID"]
PORTAL_UNFOLLOWED_PAGES = ["downloadissueinfo.aspx", "showvalidatecode.aspx", "validatecode.aspx", "quit.aspx", "wkdownfilebylink.aspx", "kbdownload.aspx"]
ROUTES_LEAF_KINDS = ["detail", "issue_detail", "english_issue"]
PORTAL_LEAF_KINDS = ["cbpt_article", "cbpt_aux", "cbpt_guard", "cbpt_portal_article", "cbpt_portal_api", "cbpt_portal_aux"]
LIGHT_KINDS = [
    "ajcass_cms_article", "ajcass_cms_detail", "detail", "issue_detail", "english_issue", "cbpt_article", "cbpt_portal_article",
    "cbpt_portal_news", "cbpt_aux", "cbpt_portal_aux",
]
HEAVY_KINDS = [
    "ajcass_cms_archive", "ajcass_cms_issue", "ajcass_cms_list", "root", "issue_search", "english_index", "cbpt_list",
    "cbpt_portal_index", "cbpt_portal_list", "page",
]
LIGHT_PATH_PARTS = ["/view", "/show", "/detail", "/content", "/article", "/paper", "/newsview", "/abstract"]
LIGHT_URL_PARTS = ["articledetail", "paperid=", "contentid=", "articleid=", "newsid=", "detailid="]
KIND_RANKS = {
    0: ["root", "ajcass_cms_archive", "ajcass_cms_issue", "issue_search", "english_index", "cbpt_list", "cbpt_portal_index", "cbpt_portal_list"],
    1: ["ajcass_cms_list", "detail", "issue_detail", "english_issue", "cbpt_article", "cbpt_portal_article", "cbpt_portal_news"],
    3: ["cbpt_portal_aux", "cbpt_aux"],
    4: ["resource"],
}
TRANSPORT_ERRORS = [
    "connection closed while reading from the driver", "target page, context or browser has been closed", "browser has been closed",
    "connection closed", "target closed", "protocol error", "session closed", "closed while reading",
]

# --- fixed values: patterns ----------------------------------------------------------------------------------------
PSEUDO_SCHEMES = "javascript:|mailto:|tel:|data:"
ABSOLUTE_URL = "(?i)https?://[^\\s\"'<>]+"
RELATIVE_URL = "(?:/|\\./|\\.\\./|\\?)[^\\s\"'<>]+"
HASH_ROUTE = "#/[A-Za-z0-9_./?=&%-]+"
FAMILY_ROUTE = "(?i)(?:^|[\"'=])((?:/|#/)(?:index|detail|search|issueDetail|issue|enIndex|enIssue)[^\\s\"'<>]*)"
ATTRIBUTE = "(?is)(href|src|action|data-href|data-url|data-src|poster|onclick)\\s*=\\s*([\"'])(.*?)\\2"
ISSUE_LIST_ACTION = "(?i)(?:action|href)\\s*=\\s*([\"'])([^\"']*issue_list\\.aspx[^\"']*)\\1"
YEAR_ID = "(?i)yearid\\s*\\[\\s*\\d+\\s*\\]\\s*=\\s*[\"'](\\d{4})[\"']"
QUARTER_ID = "(?i)quarternameid\\s*\\[\\s*\\d+\\s*\\]\\s*=\\s*[\"'](\\d{4}:\\d{1,2}):[^\"']+[\"']"
SCRIPT_ROUTE = "(?i)(?:path|redirect|to)\\s*:\\s*[\"'](/[A-Za-z0-9_./?=&%-]*)[\"']"
HASH_ROUTER_MARKS = ["location.hash", "hashchange", "mode:\"hash\"", "mode:'hash'", "#/"]
HISTORY_ROUTER_MARKS = ["createWebHistory", "mode:\"history\"", "mode:'history'", "new VueRouter", "routes:[", "routes = ["]
JS_CALL = "(?s)^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*\\((.*)\\)\\s*;?\\s*$"
JS_STRING = "(?s)([\"'])(.*?)(?<!\\\\)\\1"
TEXT_ENTITIES = ["&quot;", "&#34;", "&#39;", "&apos;", "&gt;", "&lt;"]
LINK_MARKS = ["href=", "src=", "action=", "data-href", "data-url", "data-src", "location.href", "window.location", "open("]
PAGE_MARKS = [".aspx", ".do?", ".do&", ".do#", ".html", ".htm", ".jsp", ".php", ".shtml", "#/"]
HTML_LIMIT = 2_000_000
