"""Model request and response tables (H1-H9) as column expressions.

Calls to a hosted model are not made here. What is data work is building the
request text for every row at once and validating a response table in bulk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c

# Request texts of the reference (wording must match).
SUMMARY_SYSTEM = ("You are a documentation summarizer that creates concise, informative "
                  "descriptions and summaries.")
SUMMARY_INTRO = ("Analyze this page content and provide:\n"
                 "1. A one-line description (50-100 characters) that captures the essence of the page\n"
                 "2. If there's substantial content, a one-paragraph summary (200-500 characters)\n\n")
SUMMARY_OUTRO = ("\n\nReturn as JSON with \"description\" and \"summary\" fields.\n"
                 "If the content is too brief or lacks substance, return empty string for \"summary\".")
SCORE_SYSTEM = """You are a content change analyzer. Evaluate the semantic importance of changes shown in a git-style diff.

Score the changes on a scale of 1-4:
- 1: Minor/insignificant (typos, whitespace, formatting, date updates, trivial wording)
- 2: Moderate (small content updates, minor corrections, updated examples)
- 3: Significant (new information, meaningful content updates, structural changes)
- 4: Major (substantial new content, new features/sections, fundamental changes)

Consider:
- Volume of changes
- Type of changes (factual updates vs formatting)
- Impact on documentation meaning
- Value for users/LLMs consuming this content

Return ONLY a single integer (1, 2, 3, or 4). No explanation."""
ENHANCE_SYSTEM = """You are a documentation processor. Your task is to clean and enhance markdown content for inclusion in an llms.txt file.

Instructions:
1. Remove unnecessary metadata, navigation elements, and boilerplate
2. Preserve all important technical information
3. Improve structure and clarity where needed
4. Keep code examples intact
5. Maintain markdown formatting
6. Focus on content that would be valuable for an LLM to understand the documentation

Return only the processed markdown content without any additional commentary."""
OVERVIEW_SYSTEM = """You are an expert web analyst creating comprehensive llms.txt documentation.
Your task is to analyze a website and create a professional overview suitable for LLM consumption.
Focus on clarity, structure, and providing valuable context about the site's purpose and content."""
OVERVIEW_OUTRO = """

Generate:
1. A concise site description (2-3 sentences)
2. The main purpose and target audience
3. Key features or services offered
4. Technical implementation notes if relevant

Format as markdown with clear sections."""
CATEGORY_SYSTEM = """You are organizing website pages into logical categories for documentation.
Group pages based on their purpose and content type."""
CATEGORY_OUTRO = """

Return a JSON object where keys are category names and values are arrays of URLs.
Use categories like: "Documentation", "API Reference", "Features", "Getting Started", "About", "Legal", etc.

Example format:
{
  "Documentation": ["/docs/guide", "/docs/api"],
  "Features": ["/features/analytics", "/features/security"]
}"""
SHORT_SUMMARY_SYSTEM = """You are creating concise, informative summaries for an llms.txt file.
Focus on the main purpose, key information, and technical details that would be valuable for LLMs."""
SHORT_SUMMARY_OUTRO = """

Create a single paragraph that captures:
- The page's main purpose
- Key information or features
- Any technical details worth noting

Be concise but informative."""
DEFAULT_DESCRIPTION = "Page content"


# H6: texts, and the names of the values between them
SITE_DOCUMENT = [
    "Format the following website content according to the llms.txt specification.\n\nDomain: ", "domain",
    "\n\nSite Overview:\n", "overview", "\n\nAll pages on this site:\n", "pages",
    "\n\nOutput format requirements:\n"
    "1. Start with main title using # (domain name)\n"
    "2. Add site description using > quote syntax\n"
    "3. Include relevant details about the site in plain text\n"
    "4. Create ## sections for major topics/categories\n"
    "5. Use - [Link title](url) format for links with brief descriptions\n"
    "6. Add an optional \"## Optional\" section at the end for less critical pages\n\n"
    "Example format:\n# ", "domain",
    "\n\n> One-line site description goes here\n\nKey details and context about the site.\n\n"
    "## Main Section\n\n"
    "- [Page Title](https://example.com/page): Brief description of this page\n"
    "- [Another Page](https://example.com/other): Description of what this page contains\n\n"
    "## Optional\n\n"
    "- [Additional Resource](https://example.com/resource): Less critical content\n\n"
    "Generate the llms.txt content following this exact structure. Be concise but informative.\n"
    "Organize pages into logical sections based on their purpose and content."]


def _nz(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def page_summary_request(content, title, description) -> Column:        # H1
    """User message of the page-summary request: optional title and
    description lines, first 8000 chars, '...[truncated]' marker."""
    c, t, d = _c(content), _c(title), _c(description)
    return F.concat(
        F.lit(SUMMARY_INTRO),
        F.when(_nz(t), F.concat(F.lit("Page title: "), t)).otherwise(F.lit("")), F.lit("\n"),
        F.when(_nz(d), F.concat(F.lit("Existing description: "), d)).otherwise(F.lit("")),
        F.lit("\n\nPage content:\n"), F.substring(c, 1, 8000), F.lit(" "),
        F.when(F.length(c) > 8000, F.lit("...[truncated]")).otherwise(F.lit("")),
        F.lit(SUMMARY_OUTRO))


def parse_summary_response(response) -> tuple[Column, Column]:          # H2
    """(description <= 100 chars, default 'Page content'; summary <= 500
    chars, default ''); unparsable or missing JSON gives the defaults."""
    js = F.from_json(_c(response), "struct<description:string,summary:string>")
    desc = js["description"]
    summ = js["summary"]
    return (F.substring(F.when(_nz(desc), desc).otherwise(F.lit(DEFAULT_DESCRIPTION)), 1, 100),
            F.substring(F.when(_nz(summ), summ).otherwise(F.lit("")), 1, 500))


def change_score_request(diff_text) -> Column:                          # H3
    return F.concat(F.lit("Evaluate these changes:\n\n"), _c(diff_text))


def enhancement_request(content, profile_prompt) -> tuple[Column, Column]:   # H4
    """(system, user) messages: the profile's prompt when set, else the default."""
    system = F.coalesce(_c(profile_prompt), F.lit(ENHANCE_SYSTEM))
    return system, F.concat(F.lit("Process the following markdown content:\n\n"), _c(content))


def overview_request(domain, page_count, first_urls) -> Column:          # H5
    """``first_urls``: the first ten '- url' lines joined with newlines."""
    return F.concat(F.lit("Create a comprehensive overview for "), _c(domain),
                    F.lit(".\nThe site has "), _c(page_count).cast("string"),
                    F.lit(" pages. Here are some key URLs to understand the site structure:\n"),
                    _c(first_urls), F.lit(OVERVIEW_OUTRO))


def category_request(page_lines) -> Column:                              # H5 (categories)
    """``page_lines``: '- url (title)' lines joined with newlines."""
    return F.concat(F.lit("Categorize these pages into logical groups:\n"), _c(page_lines), F.lit(CATEGORY_OUTRO))


def site_page_context(title, url, description, summary) -> Column:       # H6 (one page)
    s = _c(summary)
    return F.concat(F.lit("\n- Title: "), _c(title), F.lit("\n  URL: "), _c(url),
                    F.lit("\n  Description: "), _c(description), F.lit("\n  "),
                    F.when(_nz(s), F.concat(F.lit("Summary: "), s)).otherwise(F.lit("")))


def site_document_request(domain, overview, pages_context) -> Column:    # H6
    values = {"domain": _c(domain), "overview": _c(overview), "pages": _c(pages_context)}
    return F.concat(*[values[x] if x in values else F.lit(x) for x in SITE_DOCUMENT])


def site_document_sql(domain: str, overview: str, pages_context: str, literal) -> str:
    """The same as an SQL expression; ``literal`` spells a text in SQL."""
    values = {"domain": domain, "overview": overview, "pages": pages_context}
    return " || ".join(values[x] if x in values else literal(x) for x in SITE_DOCUMENT)


def token_estimate(*messages) -> Column:                                 # H8
    """ceil(chars / 4) per message, summed over the request's messages."""
    total = F.lit(0).cast("long")
    for m in messages:
        total = total + F.ceil(F.length(F.coalesce(_c(m), F.lit(""))) / 4).cast("long")
    return total


def short_summary_request(url, content, max_length: int = 200) -> Column:   # H9
    return F.concat(F.lit("Summarize this page from "), _c(url), F.lit(f" in {max_length} characters or less:\n\n"),
                    F.substring(_c(content), 1, 3000), F.lit(SHORT_SUMMARY_OUTRO))
