"""Schemas of the core tables, as DDL."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "customers": "customer_id long, persona string, uplift_segment_true string, signup_date timestamp_ntz, "
    "acquisition_month string, region string, device_type string, acquisition_channel string, "
    "price_sensitivity double, coupon_affinity double, treatment_lift_base double",
    "events": "event_id string, customer_id long, timestamp timestamp_ntz, event_type string, session_id string, "
    "item_category string, quantity int",
    "orders": "order_id string, customer_id long, order_time timestamp_ntz, item_category string, quantity int, "
    "gross_amount double, discount_amount double, net_amount double, coupon_used int",
    "treatment_assignments": "customer_id long, treatment_group string, treatment_flag int, campaign_type string, "
    "coupon_cost int, assigned_at timestamp_ntz",
    "campaign_exposures": "exposure_id string, customer_id long, exposure_time timestamp_ntz, campaign_type string, "
    "coupon_cost int",
    "state_snapshots": "customer_id long, snapshot_date timestamp_ntz, last_visit_date timestamp_ntz, "
    "last_purchase_date timestamp_ntz, visits_total int, purchases_total int, monetary_total double, "
    "inactivity_days int, current_status string, recent_visit_score double, recent_purchase_score double, "
    "recent_exposure_score double, coupon_fatigue_score double, discount_dependency_score double",
    "customer_summary": "customer_id long, persona string, uplift_segment string, treatment_group string, "
    "recency_days double, frequency double, monetary double, churn_probability double, uplift_score double, "
    "clv double, coupon_cost double, expected_incremental_profit double, expected_roi double",
}
