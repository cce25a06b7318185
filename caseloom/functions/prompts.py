"""Prompt text for the model steps.  Own wording, the fields of the ticket contract."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import REPRESENTATIVE_CHARS, truncate_middle

MAX_REPRESENTATIVES = 5


def _line(label: str, value: Column, default: str) -> Column:
    return F.concat(F.lit(label), F.coalesce(F.nullif(value, F.lit("")), F.lit(default)), F.lit("\n"))


def simple_prompt(subject: Column, description: Column) -> Column:
    return F.concat(
        F.lit("Summarize this support ticket with the facts it states and nothing else. Sections: "
              "Issue, Problem, Technical, Keywords.\n"),
        _line("Subject: ", subject, "No subject"),
        F.lit("Content: "),
        F.coalesce(F.nullif(truncate_middle(description), F.lit("")), F.lit("No description provided")),
    )


def full_prompt(*, ticket_id: Column, subject: Column, status: Column, priority: Column, created_at: Column,
                requester: Column, agent: Column, organization: Column, region: Column, tags: Column,
                custom_fields: Column, comment_count: Column, word_count: Column, conversation: Column) -> Column:
    return F.concat(
        F.lit("Summarize this support ticket in English with the facts it states and nothing else. Sections: "
              "Issue, Problem, Technical, Resolution, Images, Keywords.\n"),
        _line("Ticket: ", ticket_id, "unknown"),
        _line("Subject: ", subject, "No subject"),
        _line("Status: ", status, "unknown"),
        _line("Priority: ", priority, "Not set"),
        _line("Created: ", created_at, "unknown"),
        _line("Requester: ", requester, "Unknown"),
        _line("Agent: ", agent, "Unassigned"),
        _line("Organization: ", organization, "Unknown"),
        _line("Region: ", region, "Unknown"),
        F.lit("Tags: "), F.coalesce(F.array_join(tags, ", "), F.lit("")), F.lit("\n"),
        F.lit("Custom fields:\n"), custom_fields, F.lit("\n"),
        F.lit("Conversation ("), comment_count.cast("string"), F.lit(" comments, "), word_count.cast("string"),
        F.lit(" words):\n"), conversation,
    )


def cluster_prompt(representatives: Column, keywords: Column) -> Column:
    """At most five representative texts, each cut to the representative length."""
    texts = F.transform(F.slice(representatives, 1, MAX_REPRESENTATIVES), lambda t, i: F.concat(
        F.lit("Ticket "), (i + 1).cast("string"), F.lit(":\n"), F.substring(t, 1, REPRESENTATIVE_CHARS)))
    return F.concat(
        F.lit("Describe what these tickets have in common. Answer with one JSON object holding label, "
              "issue_description, common_symptoms, environment, recommended_response and deflection_path.\n"),
        F.array_join(texts, "\n"), F.lit("\nKeywords: "),
        F.coalesce(F.array_join(keywords, ", "), F.lit("")),
    )


def routing_prompt(message: Column, clusters: Column, tickets: Column) -> Column:
    return F.concat(
        F.lit("Route this message to a cluster and draft a reply. Answer with one JSON object holding "
              "predicted_cluster, cluster_label, confidence, recommended_actions, draft_reply and "
              "ask_for_info.\nMessage: "), message,
        F.lit("\nClusters:\n"), F.coalesce(F.nullif(clusters, F.lit("")), F.lit("No cluster data available yet.")),
        F.lit("\nSimilar tickets:\n"), F.coalesce(F.nullif(tickets, F.lit("")), F.lit("No similar tickets found.")),
    )
