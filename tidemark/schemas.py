"""Columns of the tables."""

FILING = (
    "filing_id string, mark_text string, mark_type string, mark_category string, filing_date date, publication_date date, applicant_name string, "
    "applicant_country string, applicant_region string, applicant_postcode_area string, nice_classes array<int>, goods_text string, "
    "goods_text_available boolean, series_count int, status string, batch_id string, source_url string, source_name string, ordinal bigint"
)
COMPANY = (
    "name_key string, company_name string, company_number string, company_status string, company_category string, incorporation_date date, "
    "dissolution_date date, sic_codes array<string>, region string, post_town string, country string, accounts_category string"
)
SEARCH_RESULT = "query string, rank int, title string, url string, snippet string"
PROSPECT = (
    "prospect_id string, company_name string, website string, companies_house_number string, company_type string, supplier_category string, "
    "supplier_subcategory string, geography string, icp_reason string, products_services string, buying_intent_categories string, contact_route string, "
    "company_size_hint string, researched_date string, research_exclusion string, research_notes string"
)
